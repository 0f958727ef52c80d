"""Schemas of requests, responses, cache entries, workflow documents and progress records."""

from __future__ import annotations

#: Fixed value of the service's protocol, as are the field names below.
NEGATIVE_PROMPT = "blur, low quality, distortion, watermark"

INPAINT_REQUEST = "source_id string, prompt string, negative_prompt string, mask_image_base64 string, seed bigint"
PATCH = "x int, y int, width int, height int, color string, mask string"
CACHE_OPERATION = "cache_id string, seq bigint, op string, source_id string, extension string, length bigint"
CACHE_EVENT = "cache_id string, seq bigint, op string, source_id string, outcome string, path string"
WORKFLOW = "map<string, struct<class_type: string, inputs: map<string, string>, _meta: struct<title: string>>>"
PROGRESS = "type string, data struct<node: string, prompt_id: string>"
IMAGE_REF = "struct<filename: string, subfolder: string, type: string>"
