"""Defaults of the engine, in one place."""

from __future__ import annotations

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
MIN_PAGE_CHARS = 50
MIN_CHUNK_CHARS = 20
REPEAT_SHARE, REPEAT_LEAST, REPEAT_LINE_CHARS = 0.4, 2, 80
BREAKPOINT, SMALL_GROUP_TOKENS, MIN_SENTENCE_CHARS = 0.75, 100, 15
RETRIEVE_K, RERANK_K, SEARCH_K_MOST, CHAT_K, CHAT_K_MOST = 20, 5, 50, 5, 10
CONTEXT_TOKENS, BLOCK_TOKENS, LEAST_CUT_CHARS = 6000, 20, 200
HISTORY_TURNS, HISTORY_CHARS = 6, 400
PREVIEW_CHARS = 120
UPLOAD_BYTES = 20 * 1024 * 1024
EMBED_DIM = 768
EMBED_MODEL = "hash-embedder-v1"
COLLECTION_STRATEGIES = ("per_document", "per_user", "global")
GLOBAL_COLLECTION = "strataq_chunks"
STATUSES = ("pending", "processing", "ready", "failed")
STRATEGIES = ("fixed", "recursive", "semantic")
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
