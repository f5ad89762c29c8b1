"""corpusflow.plans"""
