"""varloom.plans"""
