"""strandlog.plans"""
