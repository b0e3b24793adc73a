
from __future__ import annotations

ISSUE = "struct<severity:string,title:string,detail:string>"
REFERENCE = "struct<source:string,page:int>"
ATTACHMENT = "struct<name:string,size:bigint,type:string>"

ANSWER = (
    f"summary string, story array<string>, issues array<{ISSUE}>, "
    f"recommendations array<string>, references array<{REFERENCE}>"
)

CONVERSATION = (
    "id string, title string, agent string, created_at timestamp, updated_at timestamp"
)

MESSAGE = (
    "id string, conversation_id string, role string, content string, "
    f"structured string, attachments array<{ATTACHMENT}>, created_at timestamp"
)

CONVERSATION_TURN = "conv_id bigint, turn bigint, role string, text string"

EVENT = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
