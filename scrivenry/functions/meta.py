"""Work metadata: keywords and their canonical tags, flags, the adult rating, and control tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivenry.functions.text import collapse_space, fold, nfkc

# Canonical tags, in the order of the flags, each with the spellings that stand for it.
TAG_SPELLINGS: dict[str, list[str]] = {
    "R15": ["R15", "Ｒ１５", "R-15", "r15"],
    "残酷な描写あり": ["残酷な描写あり", "残酷描写あり", "残酷な描写有り", "残酷シーンあり"],
    "ボーイズラブ": ["ボーイズラブ", "BL", "bl", "Boys Love", "ボーイズラヴ"],
    "ガールズラブ": ["ガールズラブ", "GL", "gl", "Girls Love", "百合"],
    "異世界転生": ["異世界転生", "異世界へ転生", "異世界転生もの", "いせかい転生"],
    "異世界転移": ["異世界転移", "異世界へ転移", "異世界転移もの", "いせかい転移"],
    "男主人公": ["男主人公", "男性主人公", "主人公は男性", "男性が主人公"],
    "女主人公": ["女主人公", "女性主人公", "主人公は女性", "女性が主人公"],
    "群像劇": ["群像劇", "群像劇もの", "群像劇形式"],
    "オリジナル戦記": ["オリジナル戦記", "オリジナル戦記もの", "オリジナル戦記モノ"],
    "架空戦記": ["架空戦記", "架空戦記もの", "架空戦記モノ"],
    "IF戦記": ["IF戦記", "if戦記", "ＩＦ戦記", "IF戦記もの"],
    "ミリタリー": ["ミリタリー", "ミリタリ", "military", "Military"],
    "戦争": ["戦争", "戦争もの", "war", "War"],
    "TS": ["TS", "ts", "ＴＳ", "性転換", "ティーエス"],
    "ハーレム": ["ハーレム", "はーれむ", "ハーレムもの", "ハーレム系"],
    "恋愛": ["恋愛", "恋愛もの", "ラブロマンス", "れんあい"],
    "学園": ["学園", "学園もの", "学校", "学園系"],
    "現代": ["現代", "現代もの", "現代日本", "現代社会"],
    "歴史": ["歴史", "歴史もの", "史実", "歴史系"],
    "SF": ["SF", "sf", "ＳＦ", "サイエンスフィクション"],
    "ホラー": ["ホラー", "ほらー", "ホラーもの", "ホラー系"],
    "ミステリー": ["ミステリー", "ミステリ", "推理", "mystery", "Mystery"],
}
# The genre and setting that a flag stands for.
GENRE_OF_FLAG = {
    "オリジナル戦記": "original_war_chronicle", "架空戦記": "fictional_war_chronicle", "IF戦記": "if_war_chronicle",
    "ミリタリー": "military", "戦争": "war", "ハーレム": "harem", "恋愛": "romance", "学園": "school",
    "現代": "contemporary", "歴史": "historical", "SF": "sf", "ホラー": "horror", "ミステリー": "mystery",
    "ボーイズラブ": "bl", "ガールズラブ": "gl", "TS": "ts", "群像劇": "ensemble_cast",
}
SETTING_OF_FLAG = {"異世界転生": "isekai_reincarnation", "異世界転移": "isekai_transfer", "歴史": "historical", "現代": "contemporary", "学園": "school"}
# Extracted genders under the names that control tags use.
GENDER_NAMES = {"male": "male", "female": "female", "multiple": "multiple", "non_human_or_none": "non_human", "unclear": "unknown"}
MOVED_WORLDS = ["reincarnation", "transfer"]


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def source_keywords(main_tag: Column | str, sub_tag: Column | str) -> Column:
    """Tokens of both tag columns, null as ''."""
    both = F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (main_tag, sub_tag)])
    return F.filter(F.split(collapse_space(both), " ", -1), lambda t: t != "")


def normalise_keywords(df: DataFrame, column: str, out: str, spellings: dict[str, list[str]] = TAG_SPELLINGS) -> DataFrame:
    """Adds ``out``: canonical tags where the folded spelling is known, else the NFKC form; first ones kept.

    Both Python functions see a row's tokens joined, once each.
    """
    import unicodedata

    known = {unicodedata.normalize("NFKC", v).casefold(): tag for tag, own in spellings.items() for v in own}
    mark, tokens = "\x00", F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    df = df.withColumn("__joined", F.array_join(tokens, mark)).withColumns({"__fold": fold("__joined"), "__nfkc": nfkc("__joined")})
    pairs = F.zip_with(F.split("__fold", mark, -1), F.split("__nfkc", mark, -1), lambda k, v: F.coalesce(F.try_element_at(_map(known), k), v))
    return df.withColumn(out, F.array_distinct(F.filter(pairs, lambda t: t != ""))).drop("__joined", "__fold", "__nfkc")


def flags(keywords: Column | str, names: list[str] | None = None) -> Column:
    """map<string, boolean>: which of the names are among the keywords."""
    names = names or list(TAG_SPELLINGS)
    keys = F.array(*map(F.lit, names))
    own = F.coalesce(F.col(keywords) if isinstance(keywords, str) else keywords, F.array().cast("array<string>"))
    return F.map_from_arrays(keys, F.transform(keys, lambda n: F.array_contains(own, n)))


def adult_rating(sub_site: Column, rating: Column, url_flag: Column) -> Column:
    """struct<is_r18, source>: the first of sub_site = 2, rating = 1 and a true url flag."""
    source = F.when(sub_site == 2, "sub_site").when(rating == 1, "rating").when(F.coalesce(url_flag.cast("int"), F.lit(0)) != 0, "url_entity").otherwise("none")
    return F.struct((source != "none").alias("is_r18"), source.alias("source"))


def control_tags(flag: Column, classification: Column | None = None) -> Column:
    """struct<genre, setting, protagonist_gender, viewpoint, tone> from flags and a work's classification
    (struct<genre, setting<world, era>, protagonist<gender>, narrative<viewpoint>, tone>, may be null)."""
    empty = F.array().cast("array<string>")
    has = lambda n: F.coalesce(F.try_element_at(flag, F.lit(n)), F.lit(False))
    of = lambda table: F.array_compact(F.array(*[F.when(has(f), F.lit(t)) for f, t in table.items()]))
    get = lambda path: F.lit(None).cast("string") if classification is None else classification[path[0]][path[1]]
    listed = lambda name: empty if classification is None else F.coalesce(classification[name], empty)
    places = F.filter(F.array(get(("setting", "world")), get(("setting", "era"))), lambda v: v.isNotNull() & ~v.isin("", "unknown"))
    male, female = has("男主人公"), has("女主人公")
    gender = F.when(male & ~female, "male").when(female & ~male, "female").otherwise(F.coalesce(get(("protagonist", "gender")), F.lit("unknown")))
    return F.struct(
        F.array_distinct(F.concat(of(GENRE_OF_FLAG), listed("genre"))).alias("genre"), F.array_distinct(F.concat(of(SETTING_OF_FLAG), places)).alias("setting"),
        gender.alias("protagonist_gender"), F.coalesce(get(("narrative", "viewpoint")), F.lit("unknown")).alias("viewpoint"), listed("tone").alias("tone"),
    )


def classify_works(works: DataFrame, features: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """works (ncode, control_flags) with features (ncode, ok, features) and viewpoints (ncode, viewpoint):
    a classification for each work; a moved world counts only where the author declared none."""
    good = features.where("ok").select("ncode", F.col("features.protagonist_gender").alias("g"), F.col("features.world_transfer").alias("w"))
    declared = F.coalesce(F.try_element_at("control_flags", F.lit("異世界転生")), F.lit(False)) | F.coalesce(F.try_element_at("control_flags", F.lit("異世界転移")), F.lit(False))
    world = F.when(~declared & F.col("w").isin(MOVED_WORLDS), "isekai")
    joined = works.join(good, "ncode", "left").join(viewpoints.select("ncode", "viewpoint"), "ncode", "left")
    return joined.select(
        "ncode", F.array().cast("array<string>").alias("genre"), F.struct(world.alias("world"), F.lit(None).cast("string").alias("era")).alias("setting"),
        F.struct(F.coalesce(F.try_element_at(_map(GENDER_NAMES), F.col("g")), F.lit("unknown")).alias("gender")).alias("protagonist"),
        F.struct(F.coalesce("viewpoint", F.lit("unknown")).alias("viewpoint")).alias("narrative"), F.array().cast("array<string>").alias("tone"),
    )


def site_name(site_type: Column) -> Column:
    return F.when(site_type == 1, "syosetu").otherwise("kakuyomu")


def provenance(work_used: Column, chunk_used: Column, work_confidence: Column, chunk_confidence: Column) -> Column:
    """struct<method, confidence>: a chunk's confidence before the work's, 0 by default."""
    method = F.when(work_used | chunk_used, "rules+lmstudio").otherwise("rules")
    return F.struct(method.alias("method"), F.when(chunk_used, chunk_confidence).when(work_used, work_confidence).otherwise(0.0).alias("confidence"))
