"""varloom.functions"""
