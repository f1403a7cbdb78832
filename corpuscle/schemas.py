"""Declared schemas of the logical tables; sources are read with these, never inferred."""

from __future__ import annotations

SECTIONS = "array<struct<level:int,title:string,content:string,subsections:array<struct<level:int,title:string,content:string>>>>"

RAW_TEXT = "file_name string, text string"
GLOSSARY = "term string, pronunciation string, description string"
BOOK = (
    "book_number int, book_title string, "
    "chapters array<struct<chapter_number:int,chapter_type:string,chapter_title:string,content:string>>, "
    f"glossary array<struct<{GLOSSARY.replace(' string', ':string').replace(', ', ',')}>>"
)
PAGE = f"filename string, page_type string, page_name string, page_id bigint, categories array<string>, sections {SECTIONS}"
REDIRECT = "redirect string, canonical string"
CATEGORY = "filename string, category string"
DICTIONARY = "dict_name string, canonical string, aliases array<string>, ord int"
TAXONOMY = "group string, category string, group_priority int"
CHUNK = (
    "chunk_id string, source string, wiki_type string, filename string, page_name string, character_name string, "
    "section_title string, book_number int, book_title string, chapter_number int, chapter_title string, "
    "chapter_type string, temporal_order int, chunk_index int, total_chunks int, text string, categories array<string>, "
    "character_mentions array<string>, concept_mentions array<string>, magic_mentions array<string>, prophecy_mentions array<string>"
)
EMBEDDING = "chunk_id string, embedding array<float>, text string"
RESULT = "text string, metadata map<string,string>, distance double, boosted_score double"
ISSUE = "type string, source string, chunk_index int, length int, missing_fields array<string>"
