"""Training-data operators: near and exact deduplication, classifiers, search,
mixing, tokenisation, web archives and chat formatting, each as a Spark job.

Every module has one operator with a general interface; ``queries`` holds the
thin registered queries and their SQL twins.
"""
