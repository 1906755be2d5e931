"""revcast.sources"""
