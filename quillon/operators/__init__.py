"""DataFrame operators: index statistics, retrieval, extraction, chunking, chat, serving."""
