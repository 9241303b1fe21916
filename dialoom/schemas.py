"""Schemas (as DDL) of the tables and records the engine reads and writes."""

from __future__ import annotations

#: One row per picture item with its nested dialogue; both turn dialects fit.
CORPUS = "id BIGINT, image BINARY, description STRING, conversations ARRAY<STRUCT<role: STRING, content: STRING, `from`: STRING, value: STRING>>"

#: One row per delivered turn (the exploded corpus).
CONVERSATIONS = "msg_id BIGINT, conv_id BIGINT, turn BIGINT, role STRING, content STRING, annotator_id BIGINT, created_at TIMESTAMP, loaded_at TIMESTAMP"

#: Format B: one question and one answer.
RECORD = "id STRING, image STRING, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>"

#: Format A: messages with typed content parts.
MESSAGE_RECORD = "id STRING, image STRING, conversations ARRAY<STRUCT<role: STRING, content: ARRAY<STRUCT<type: STRING, image: STRING, text: STRING>>>>, original_index BIGINT"

PREDICTION = "id STRING, question STRING, ground_truth STRING, prediction STRING"

SCORED = "id STRING, question STRING, ground_truth STRING, prediction STRING, exact_match BOOLEAN, similarity DOUBLE"

CHECKPOINTS = "name STRING"
