"""lumenframe.sources"""
