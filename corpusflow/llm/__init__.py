"""corpusflow.llm"""
