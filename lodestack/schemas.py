"""Explicit schemas of every stored table and file; nothing is ever inferred."""

from __future__ import annotations

FILES = "path STRING, length LONG, modificationTime TIMESTAMP, content BINARY"
CHUNKS = "chunk_id STRING, raw_size INT, stored_size LONG, codec STRING, payload BINARY"
CATALOG = "chunk_id STRING, stored_size LONG"
MANIFEST = "path STRING, bytes LONG, chunks ARRAY<STRING>"
LINE_MANIFEST = "snapshot STRING, path STRING, mode STRING, bytes LONG, chunks ARRAY<STRUCT<id: STRING, size: LONG>>"
SIDECAR = "k INT, r INT, shardSize INT, chunks ARRAY<STRING>, sizes ARRAY<INT>"
STRIPES = "stripe_id LONG, k INT, r INT, shard_size INT, chunks ARRAY<STRING>, sizes ARRAY<INT>, parity ARRAY<BINARY>"
FILE_STRIPES = "stripe_id STRING, k INT, r INT, shard_size INT, chunks ARRAY<STRING>, sizes ARRAY<INT>, parity ARRAY<BINARY>"
STRIPE_INDEX = "chunk_id STRING, stripe_id LONG, pos INT"
INDEX = "chunk_id STRING, drive_ord INT"
DRIVES = "drive_ord INT, drive_id STRING, label STRING"
INVENTORY = "repo_id STRING, repo_name STRING, drive_id STRING, label STRING, created_at LONG, n LONG, m_bits INT, k INT, bits BINARY"
