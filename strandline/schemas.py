"""Explicit schemas of everything that is read or written."""

from __future__ import annotations

CHANGE_RECORD = "title string, comment string, revid bigint, old_revid bigint, timestamp string"
_CLAIM = "struct<mainsnak: struct<snaktype: string, datatype: string, datavalue: struct<value: string>>>"
ENTITY = f"id string, missing string, labels map<string, struct<value: string>>, sitelinks map<string, struct<title: string>>, claims map<string, array<{_CLAIM}>>"
REVISION = "revid bigint, content string"
LABEL = "id string, label string"
CHANGES = (
    "entity_id string, entity_label string, property_id string, property_label string, property_type string, old_value string, "
    "new_value string, new_value_label string, change_type string, change_timestamp string, wiki_url string"
)
TRIPLES = "subject_id string, subject_label string, predicate_id string, predicate_label string, object_id string, object_label string"
QA_ITEM = (
    "question string, answer string, level int, year int, type string, reasoning_chain array<array<string>>, sparql_verification string, "
    f"verified_with_sparql boolean, source_triple struct<{TRIPLES.replace(' string', ': string')}>, "
    "bridge_info struct<start_entity: string, intermediate_entity: string, final_entity: string, intermediate_count: int>, "
    "constraint_info struct<constraint_count: int, total_attributes: int, constraints: array<string>>, original_level2_question string, "
    "abstraction_info struct<start_entity_abstraction: string, intermediate_entity_abstraction: string, metaphor_level: string, "
    "abstract_constraints: array<string>, original_constraints: array<string>, cultural_depth: string>, answer_verified boolean"
)
QA_ENVELOPE = f"metadata map<string, string>, qa_pairs array<struct<{QA_ITEM.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean').replace(' array<', ': array<').replace(' struct<', ': struct<').replace('::', ':')}>>"
TURNS = "item_id bigint, step int, text string"
EVALUATION = (
    "question string, expected_answer string, model_answer string, is_correct boolean, search_count int, "
    "reasoning_process array<struct<type: string, step: int, query: string, content: string>>"
)
SUMMARY = "model string, total_questions int, correct_answers int, accuracy double, test_file string, timestamp string"
