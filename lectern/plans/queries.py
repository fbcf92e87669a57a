"""All query modules; importing them fills the registry."""

from __future__ import annotations

from lectern.plans import q_items, q_lessons, q_parse, q_protocol, q_quiz, q_records, q_search, q_store, q_text, q_transcript, q_tree, q_vocabulary, q_write  # noqa: F401
