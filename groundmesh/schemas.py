"""Column types of the keyed collections."""

from __future__ import annotations

TEXT_CHUNKS = (
    "id string, content string, title string, parent_title string, concept_id string, section_id string, source_file string, type string, "
    "metadata struct<level:int,breadcrumb:array<string>,child_titles:array<string>,content_length:int>"
)
IMAGE_CHUNKS = (
    "image_id string, description string, title string, parent_title string, concept_id string, section_id string, source_file string, type string, "
    "metadata struct<linked_text_section_id:string,caption:string,svg_text_labels:array<string>,view_box:string,order_in_file:int,raw_svg_excerpt:string,breadcrumb:array<string>>"
)
RELATIONS = (
    "relation_id string, source_id string, target_id string, relation_type string, description string, "
    "metadata struct<source_file:string,sheet_name:string,row_number:int,source_label:string,target_label:string,evidence:string,placeholder:boolean>"
)
REQUIRED = {
    "text": ("id", "content", "title", "section_id", "source_file", "concept_id"),
    "image": ("image_id", "description", "title", "section_id", "source_file", "concept_id"),
    "relation": ("relation_id", "source_id", "target_id", "relation_type", "description"),
    "concept": ("concept_id", "label", "node_type"),
}
KEYS = {"text": "id", "image": "image_id", "relation": "relation_id", "concept": "concept_id"}
STORE_KINDS = {"text": "textchunk", "image": "imagechunk", "relation": "relationchunk", "concept": "conceptnode"}
TEXT_EVIDENCE = "struct<id:string,title:string,concept_id:string,source_file:string,excerpt:string,citation:string>"
IMAGE_EVIDENCE = "struct<id:string,title:string,concept_id:string,source_file:string,description:string,citation:string>"
RELATION_EVIDENCE = "struct<relation_id:string,source_id:string,target_id:string,relation_type:string,description:string,graph_relevance_score:double>"
REFERENCE = "struct<id:string,title:string,source_file:string,concept_id:string>"
MODEL_OUTPUT = (
    f"struct<compact_context:struct<key_text_evidence:array<{TEXT_EVIDENCE}>,key_image_evidence:array<{IMAGE_EVIDENCE}>,key_relations:array<{RELATION_EVIDENCE}>,source_references:array<{REFERENCE}>>,"
    f"key_text_evidence:array<{TEXT_EVIDENCE}>,key_image_evidence:array<{IMAGE_EVIDENCE}>,key_relations:array<{RELATION_EVIDENCE}>,source_references:array<{REFERENCE}>>"
)
