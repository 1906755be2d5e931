"""revcast.plans"""
