"""varloom.sources"""
