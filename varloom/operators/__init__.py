"""varloom.operators"""
