"""Fixed schemas of the corpus, closed value lists, and what stands in for an absent classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a work at its site, and the values of classifications.
AVAILABILITY = ("available", "not_found", "temporarily_unavailable", "unknown", "not_applicable")
GENDERS = ("male", "female", "other", "unknown", "multiple", "non_human")
VIEWPOINTS = ("first_person", "second_person", "third_person", "mixed", "unknown")
MINOR_RELATED = ("none", "nonsexual", "ambiguous", "sexual", "unknown")
SEVERITIES = ("violence", "gore", "sexual_content", "sexual_violence", "coercion", "self_harm", "abuse")

CONTROL_TAGS = "struct<genre:array<string>,setting:array<string>,protagonist_gender:string,viewpoint:string,tone:array<string>>"
CONTENT = "struct<violence:int,gore:int,sexual_content:int,sexual_violence:int,coercion:int,minor_related:string,self_harm:int,abuse:int>"
STYLE = (
    "struct<char_count:int,token_count:int,sentence_count:int,paragraph_count:int,avg_sentence_length:double,avg_paragraph_length:double,dialogue_ratio:double,kanji_ratio:double,hiragana_ratio:double,"
    "katakana_ratio:double,punctuation_ratio:double,question_sentence_ratio:double,exclamation_sentence_ratio:double,ellipsis_frequency:double,dash_frequency:double,bracket_dialogue_frequency:double,metrics_version:string>"
)
META = (
    "struct<ncode:string,title:string,author:string,site_type:string,is_r18:boolean,episode_no:int,episode_title:string,chunk_index:int,chunk_count_in_episode:int,source_keywords:array<string>,"
    f"api_genre:string,api_biggenre:string,content:{CONTENT},style_metrics:{STYLE},classification:struct<method:string,model:string,schema_version:int,confidence:double>,source_sha256:string>"
)
CHUNKS = f"id string, text string, control_tags {CONTROL_TAGS}, meta {META}, split string"
CHUNK_CLASSIFICATION = f"struct<scene:array<string>,tone:array<string>,content:{CONTENT},confidence:double>"
WORK_CLASSIFICATION = (
    "struct<genre:array<string>,setting:struct<world:string,era:string,locations:array<string>>,protagonist:struct<gender:string,age_group:string,roles:array<string>,group_protagonist:boolean>,"
    "narrative:struct<viewpoint:string,viewpoint_scope:string,tense:string,chronology:string>,tone:array<string>,style:struct<description_density:string,exposition_density:string,inner_monologue:string,"
    "vocabulary_register:string,pacing:string,scene_transition_frequency:string,cliffhanger_frequency:string>,confidence:double>"
)
_EMPTY = "array()"
_UNKNOWN = "'unknown'"


def default_chunk_classification() -> Column:
    levels = ", ".join(f"'{s}', 0" for s in SEVERITIES[:5]) + ", 'minor_related', 'none', " + ", ".join(f"'{s}', 0" for s in SEVERITIES[5:])
    return F.expr(f"named_struct('scene', {_EMPTY}, 'tone', {_EMPTY}, 'content', named_struct({levels}), 'confidence', 0.0D)").cast(CHUNK_CLASSIFICATION)


def default_work_classification() -> Column:
    unknown = lambda *names: ", ".join(f"'{n}', {_UNKNOWN}" for n in names)
    return F.expr(
        f"named_struct('genre', {_EMPTY}, 'setting', named_struct({unknown('world', 'era')}, 'locations', {_EMPTY}), 'protagonist', named_struct({unknown('gender', 'age_group')}, 'roles', {_EMPTY}, 'group_protagonist', false),"
        f"'narrative', named_struct({unknown('viewpoint', 'viewpoint_scope', 'tense', 'chronology')}), 'tone', {_EMPTY},"
        f"'style', named_struct({unknown('description_density', 'exposition_density', 'inner_monologue', 'vocabulary_register', 'pacing', 'scene_transition_frequency', 'cliffhanger_frequency')}), 'confidence', 0.0D)"
    ).cast(WORK_CLASSIFICATION)


def content_intensity(content: Column) -> Column:
    """The highest severity of a chunk; 0 without one."""
    return F.greatest(*[F.coalesce(content[s], F.lit(0)) for s in SEVERITIES])
