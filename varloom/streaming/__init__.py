"""varloom.streaming"""
