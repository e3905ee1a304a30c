"""Quernstone: retrieval, answer analytics and evaluation as Spark DataFrame plans."""
