"""Schemas of the layers: raw messages (L0), facts (L1), vectors, offload entries and states."""

from __future__ import annotations

L0 = "record_id string, session_key string, session_id string, role string, message_text string, recorded_at string, timestamp long"
L1 = "record_id string, content string, type string, priority double, scene_name string, session_key string, session_id string, timestamp_str string, timestamp_start string, timestamp_end string, created_time string, updated_time string, metadata_json string"
VECTORS = "record_id string, embedding array<float>, updated_time string"
OFFLOAD_ENTRY = "timestamp string, node_id string, tool_call string, summary string, result_ref string, tool_call_id string, session_key string, score double, offloaded string"
PIPELINE_STATE = "session_key string, conversation_count int, last_extraction_time string, last_extraction_updated_time string, last_active_time long, l2_pending_l1_count int, warmup_threshold int, l2_last_extraction_time string"
RUNNER_STATE = "session_key string, last_captured_timestamp long, last_l1_cursor long, last_scene_name string"
SCENE_INDEX = "filename string, summary string, heat long, created string, updated string"
SEED = "sessions array<struct<sessionKey: string, sessionId: string, conversations: array<array<struct<role: string, content: string, timestamp: string>>>>>"

L0_JSON = "sessionKey string, sessionId string, recordedAt string, id string, role string, content string, timestamp long"
L1_JSON = "id string, content string, type string, priority double, scene_name string, source_message_ids array<string>, metadata string, timestamps array<string>, createdAt string, updatedAt string, sessionKey string, sessionId string"

MEMORY_TYPES = ("persona", "episodic", "instruction")
TYPE_ALIASES = {"episode": "episodic", "instruct": "instruction", "preference": "persona"}
