"""loomwork.streaming"""
