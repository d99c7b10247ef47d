"""loomwork.sources"""
