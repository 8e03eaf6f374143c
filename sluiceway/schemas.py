"""Fixed schemas of the records jobs read and write (DDL strings)."""

VETO_AUDIT = (
    "ts STRING, stage STRING, reason STRING, detail STRING, call_id STRING, model STRING, key_alias STRING, "
    "device_fingerprint STRING, immutable BOOLEAN, evidence_id STRING"
)
IMAGE_AUDIT = f"{VETO_AUDIT}, client_ip STRING, categories ARRAY<STRING>, action STRING"
ADMIN_AUDIT = "ts STRING, actor STRING, event STRING, fields MAP<STRING,STRING>"
EVIDENCE_INDEX = "chain_id STRING, segment BIGINT, seq BIGINT, id STRING, ts STRING, stage STRING, reason STRING, categories ARRAY<STRING>, key_alias STRING, hash STRING"
REQUEST = (
    "call_id STRING, ts TIMESTAMP, model STRING, key_alias STRING, headers MAP<STRING,STRING>, messages_json STRING, "
    "system STRING, prompt ARRAY<STRING>, input ARRAY<STRING>, tools_json STRING"
)
STREAM_CHUNK = (
    "call_id STRING, seq BIGINT, choice INT, content STRING, reasoning STRING, tool_idx INT, tool_name STRING, "
    "tool_args STRING, finished BOOLEAN, choices INT"
)
REPORT = (
    "label STRING, ts STRING, base STRING, passed INT, total INT, "
    "results ARRAY<STRUCT<id:STRING, phase:STRING, desc:STRING, expected:STRING, actual:STRING, pass:BOOLEAN>>"
)
SERVICE_STATUS = "ts STRING, containers MAP<STRING, STRUCT<status:STRING, health:STRING, started:STRING, exit:INT>>"
SERVICE_RESPONSE = "ok BOOLEAN, errors ARRAY<STRING>, completed STRING, request STRUCT<targets:ARRAY<STRING>>"
GALLERY = "id STRING, user STRING, ts STRING, file STRING, prompt_id STRING, nsfw BOOLEAN, description STRING"
METRIC_SAMPLE = "metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
