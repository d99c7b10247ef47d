"""loomwork.functions"""
