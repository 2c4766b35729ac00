"""Explicit schemas of the nested inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

KNOWLEDGE_POINT = "struct<type:string,name:string,description:string,source:string,keywords:array<string>>"
SUB_PROBLEM = (
    "struct<problem_id:string,problem:string,solution:string,answer:string,answer_type:string,type_sequence:string,"
    f"guidance:string,knowledge_points:array<{KNOWLEDGE_POINT}>>"
)
COMPLETION = (
    "struct<problem_id:string,completion:string,answer:string,answer_type:string,type_sequence:string,correctness:boolean,"
    "model_judge_msg:string,extracted_answer:array<string>,normalized_gt:array<string>>"
)
ATTEMPT = f"struct<attempt_id:int,correctness:boolean,completions:array<{COMPLETION}>>"
PARENT_FIELDS = (
    "source string, year string, source_problem_id string, title string, problem string, solution string, answer string, "
    "answer_type string, type_sequence string, problem_type string, domain string, "
    f"sub_problems array<{SUB_PROBLEM}>, problems array<{SUB_PROBLEM}>"
)
FRAGMENT_FIELDS = (
    "fragment_id string, book string, book_display string, domain string, is_solution_manual boolean, chapter string, chapter_title string, "
    "section_path array<string>, heading string, anchor string, kind string, example_title string, text_md string, text_norm string, "
    "n_chars long, n_tokens_est long"
)
MATCH_FIELDS = (
    "kp_id string, fragment_id string, book string, kind string, score int, score_original int, quote string, quote_verified boolean, "
    "reason string, note string, candidate_rank int"
)


def schema(fields: str) -> StructType:
    return StructType.fromDDL(fields)


def parents() -> StructType:
    return schema(PARENT_FIELDS)


def eval_dump() -> StructType:
    return schema(f"{PARENT_FIELDS}, attempts array<{ATTEMPT}>")
