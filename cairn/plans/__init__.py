"""cairn.plans"""
