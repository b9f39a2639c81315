"""Near-duplicate groups of photos: hash pairs, components, ranks, recommendations and human protection.

Input order (``idx``) breaks every tie. Pairs are found among different hashes (``hamming``); components by alternating stars, with every round written to the shared
folder, so a lost executor costs no lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from ..functions.durable import written
from ..functions.ranks import numbered, placed
from . import graph, hamming

def average_hash(grid: Column) -> Column:
    """64 bits of an 8 x 8 grid (64 numbers), first cell highest: whether a cell is at least the mean."""
    mean = F.aggregate(grid, F.lit(0.0), lambda s, x: s + x) / F.size(grid)
    bits = F.transform(grid, lambda x: F.when(x >= mean, "1").otherwise("0"))
    return F.conv(F.array_join(bits, ""), 2, -10).cast("long")


def near_hashes(hashes: DataFrame, threshold: int) -> DataFrame:
    """a, b and distance of all different hashes (column hash, distinct) at most threshold bits apart, exactly; a < b."""
    return hamming.near(hashes, threshold)


def _hashed(photos: DataFrame, *more: str) -> DataFrame:
    return photos.where(F.col("hash").isNotNull()).select("idx", "hash", *more)


def _with_both(near: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """near with the columns of a and of b, merged. Spark would judge these by their files, gather them in the driver and send them to all tasks, though they grow with the photos."""
    return near.join(a.hint("merge"), "a").join(b.hint("merge"), "b")


def hamming_pairs(photos: DataFrame, threshold: int) -> DataFrame:
    """i < j and distance of all photos with hashes at most threshold bits apart. Hashes are compared once each, however many photos share them."""
    return _pairs(photos, threshold).select("i", "j", "distance")


def _pairs(photos: DataFrame, threshold: int, *more: str) -> DataFrame:
    """Pairs, with more columns of both as left_ and right_ (of i and of j)."""
    known = written(_hashed(photos, *more))
    hashes = known.select("hash").distinct()
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # told from one meeting, not met twice
    both = near_hashes(hashes, threshold).select("distance", F.inline(ways)).unionByName(hashes.select(F.col("hash").alias("a"), F.col("hash").alias("b"), F.lit(0).alias("distance")))
    left = known.select(F.col("idx").alias("i"), F.col("hash").alias("a"), *(F.col(c).alias(f"left_{c}") for c in more))
    right = known.select(F.col("idx").alias("j"), F.col("hash").alias("b"), *(F.col(c).alias(f"right_{c}") for c in more))
    return _with_both(both, left, right).where("i < j")


def hamming_links(photos: DataFrame, threshold: int) -> DataFrame:
    """i and j of links that connect whatever pairs connect: photos of one hash by a star around the first, and the first ones of close hashes. No more than copies and close hashes, so groups of copies cost no square."""
    known = written(_hashed(photos))
    first = written(known.groupBy("hash").agg(F.min("idx").alias("first")))
    stars = known.join(first.hint("merge"), "hash").where("idx > first").select(F.col("first").alias("i"), F.col("idx").alias("j"))
    near = near_hashes(first.select("hash"), threshold)
    a, b = first.select(F.col("hash").alias("a"), F.col("first").alias("x")), first.select(F.col("hash").alias("b"), F.col("first").alias("y"))
    return _with_both(near, a, b).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).unionByName(stars)


def hash_classes(photos: DataFrame) -> DataFrame:
    """idx, hash and class, the first photo with the same hash, of every photo with a hash."""
    known = _hashed(photos)
    return known.join(known.groupBy("hash").agg(F.min("idx").alias("class")), "hash").select("idx", "hash", "class")


def class_pairs(photos: DataFrame, threshold: int) -> DataFrame:
    """Classes (i < j, named by their first photos) of hashes at most threshold bits apart, with distance and members n_i and n_j. With ``hash_classes`` it tells every pair of photos, in rows that don't grow with the square of a group of copies."""
    first = written(_hashed(photos).groupBy("hash").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")))
    near = near_hashes(first.select("hash"), threshold)
    a, b = (first.select(F.col("hash").alias(c), F.struct("first", "n").alias(f"of_{c}")) for c in "ab")
    low, high = F.least("of_a", "of_b"), F.greatest("of_a", "of_b")
    return _with_both(near, a, b).select(low["first"].alias("i"), high["first"].alias("j"), "distance", low["n"].alias("n_i"), high["n"].alias("n_j"))


def start_groups(photos: DataFrame, threshold: int) -> DataFrame:
    """idx, hash and root, the first photo of its group, of all photos with a hash (itself if alone): the state that ``grow_groups`` carries on."""
    known = _hashed(photos)
    roots = components(hamming_links(photos, threshold))
    return known.join(roots, "idx", "left").select("idx", "hash", F.coalesce("root", "idx").alias("root"))


def grow_groups(state: DataFrame, arrived: DataFrame, threshold: int) -> DataFrame:
    """The state after photos have arrived, as if all had been grouped at once.

    Only arrived hashes probe the index of known ones, and known hashes that none of them
    can meet are told in the scan. What is contracted is the graph of labels: groups that arrived photos join,
    and the arrived ones; photos of other groups keep their root without being compared.
    Null hashes stay out; a photo whose idx is known already must not arrive again.
    """
    new = written(_hashed(arrived).groupBy("hash").agg(F.min("idx").alias("first")))
    index = written(state.groupBy("hash").agg(F.min("root").alias("root")))  # photos of one hash have one root
    among = near_hashes(new.select("hash"), threshold)
    a, b = (new.select(F.col("hash").alias(c), F.col("first").alias(f"of_{c}")) for c in "ab")
    links = _with_both(among, a, b).select(F.col("of_a").alias("u"), F.col("of_b").alias("v"))
    across = hamming.near_between(new.select("hash"), index.select("hash"), threshold)
    known = index.select(F.col("hash").alias("b"), F.col("root").alias("v"))
    links = links.unionByName(_with_both(across, a, known).select(F.col("of_a").alias("u"), "v").distinct())
    moved = written(graph.components(links).where("v <> root").select(F.col("v").alias("was"), F.col("root").alias("to")))
    mine = _hashed(arrived).join(new, "hash").select("idx", "hash", F.col("first").alias("root"))
    return state.select("idx", "hash", "root").unionByName(mine).join(moved, F.col("root") == F.col("was"), "left").select("idx", "hash", F.coalesce("to", "root").alias("root"))


def blocked_pairs(photos: DataFrame, mode: str = "standard") -> DataFrame:
    """Pairs that agree in the top 8 bits or, but for strict mode, are close in area relative to the lower index; and by distance.

    The distance is the rarer condition, so pairs are found by it, and blocks only filter them.
    """
    threshold = V.HAMMING_BY_MODE[mode]
    found = _pairs(photos, threshold, "area")
    keep = F.shiftrightunsigned("a", 56) == F.shiftrightunsigned("b", 56)
    if threshold >= 8:
        keep = keep | (F.abs(F.col("left_area") - F.col("right_area")) < F.greatest(F.col("left_area").cast("double"), F.lit(1.0)) * 0.35)
    return found.where(keep).select("i", "j", "distance")


def components(pairs: DataFrame) -> DataFrame:
    """idx and root, the smallest idx of its component, of every photo in a pair (columns i and j)."""
    return graph.components(pairs.select(F.col("i").alias("u"), F.col("j").alias("v"))).withColumnRenamed("v", "idx")


def group_quality(absolute_weight: float = 0.35) -> Column:
    """Score within a group. Where neither an absolute nor a commercial score is known, ``basic_score`` counts with 0.45 when the best is picked, and 0.35 when ranks are made; without it, 35."""
    present = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c) * w).otherwise(0.0)
    bonus = F.coalesce(V.lookup({k: float(v) for k, v in V.GROUP_RATING_BONUS.items()}, F.coalesce(F.col("quality_rating"), F.lit(""))), F.lit(float(V.GROUP_RATING_DEFAULT)))
    none = F.array().cast("array<string>")
    tags = F.array_union(F.coalesce(F.col("issue_tags"), none), F.coalesce(F.col("ai_quality_tags"), none))
    penalty = F.size(F.array_intersect(tags, V.array_of(V.GROUP_PENALTY_TAGS))) * 16.0
    lacking = (F.coalesce(F.col("absolute_quality_score"), F.lit(0.0)) == 0) & (F.coalesce(F.col("commercial_score"), F.lit(0.0)) == 0)
    spare = F.when(lacking, F.coalesce(F.col("basic_score") * absolute_weight, F.lit(35.0))).otherwise(0.0)
    return present("absolute_quality_score", 0.35) + present("commercial_score", 0.35) + present("portfolio_score", 0.15) + bonus - penalty + spare


def human_protected() -> Column:
    """Whether a human has decided on a row's group; what can't be read counts as decided."""
    text = F.coalesce(F.col("human_group_decision"), F.lit(""))
    found = F.from_json(F.when(F.trim(text).rlike(r"^\{.*\}$"), text), "struct<decision_source:string,similar_group_status:string>")
    by_json = (text != "") & (found.isNull() | F.coalesce(found["decision_source"] == "human", F.lit(False)) | F.coalesce(found["similar_group_status"].isin(V.GROUP_STATUSES), F.lit(False)))
    by_status = F.col("similar_group_status").isin(V.GROUP_STATUSES) & F.col("review_status").isin(V.CONFIRMED, V.NEEDS_REVIEW)
    return F.coalesce(F.col("best_in_group"), F.lit(False)) | ~S.blank(F.col("similar_group_note")) | by_json | F.coalesce(by_status, F.lit(False))


def recommend_reason(size: Column) -> Column:
    none = F.array().cast("array<string>")
    tags = F.array_union(F.coalesce(F.col("issue_tags"), none), F.coalesce(F.col("ai_quality_tags"), none))
    risky = F.arrays_overlap(tags, V.array_of(["虚焦", "闭眼", "表情崩"]))
    note = F.when(F.size(tags) == 0, "，未发现明显虚焦或闭眼风险").when(~risky, "，且主要风险较少").otherwise("，但仍需人工复核风险标签")
    return F.concat(F.lit("该照片在同组 "), size.cast("string"), F.lit(" 张中综合评分较高，清晰度/交付评分更稳定"), note, F.lit("，推荐作为组内最佳。"))


def assign_groups(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """photos with group columns made anew from pairs (or links); statuses of protected rows stay, and ungrouped rows are cleared.

    Sizes, first members and recommendations are aggregated, and ranks come from counts of ranges, so a group of any size isn't sorted in one task.
    """
    roots = components(pairs)
    numbers = numbered(roots.select("root").distinct(), "root", "group_no")
    member = photos.join(roots, "idx", "left")
    scored = written(member.where(F.col("root").isNotNull()).withColumns({"pick_": group_quality(0.45), "rank_": group_quality(0.35)}))
    best = F.struct("pick_", -F.col("idx"))
    groups = scored.groupBy("root").agg(F.count(F.lit(1)).alias("n_"), F.min_by("hash", "idx").alias("first_"), F.max_by("idx", best).alias("best_idx_"), F.max_by("filename", best).alias("chosen_"))
    ranked = ranked_members(scored, "rank_", "nth_").join(groups, "root").join(numbers, "root").withColumn("best_", F.col("idx") == F.col("best_idx_"))
    score = F.round(F.greatest(F.lit(0.0), 1.0 - S.hamming(F.col("first_"), F.col("hash")) / 64.0), 4)
    kept = human_protected() | ~S.blank(F.col("similar_group_status"))
    grouped = ranked.withColumns(
        {
            "similar_group_id": F.format_string("组%03d", F.col("group_no")), "similar_group_size": F.col("n_").cast("int"), "similar_group_rank": F.col("nth_"), "ai_recommended_best": F.col("best_"),
            "ai_similarity_reason": F.when(F.col("best_"), recommend_reason(F.col("n_"))).otherwise(F.concat(F.lit("与同组照片高度相似，建议对比 "), F.col("chosen_"), F.lit(" 后决定。"))),
            "similarity_score": score, "similar_group_status": F.when(kept, F.col("similar_group_status")).otherwise("review"),
        }
    )
    alone = member.where(F.col("root").isNull()).withColumns(
        {
            "similar_group_id": F.lit(""), "similar_group_size": F.lit(0), "similar_group_rank": F.lit(0), "ai_recommended_best": F.lit(False), "ai_similarity_reason": F.lit(""), "similarity_score": F.lit(0.0),
            "similar_group_status": F.when(human_protected(), F.col("similar_group_status")).otherwise(""),
        }
    )
    columns = list(dict.fromkeys([*photos.columns, *GROUP_COLUMNS]))
    return grouped.select(*columns).unionByName(alone.select(*columns))


GROUP_COLUMNS = ("similar_group_id", "similar_group_size", "similar_group_rank", "ai_recommended_best", "ai_similarity_reason", "similarity_score", "similar_group_status")


def ranked_members(members: DataFrame, score: str, name: str) -> DataFrame:
    """Adds name, the rank of each member in its group (root), by score and then input order."""
    ranked = placed(members, [F.col("root"), F.desc(score), F.col("idx")], "place_")
    before = ranked.groupBy("root").agg((F.min("place_") - 1).alias("before_"))
    return ranked.join(before, "root").withColumn(name, (F.col("place_") - F.col("before_")).cast("int")).drop("place_", "before_")


def ranked_groups(photos: DataFrame, pairs: DataFrame, score: str = "score") -> DataFrame:
    """idx, group_id, group_size, group_rank, is_best and similarity to the group's first member, by one score column.

    Sizes and first members are aggregated, and ranks come from counts of ranges, so a group of any size isn't sorted in one task.
    """
    roots = components(pairs)
    numbers = numbered(roots.select("root").distinct(), "root", "no_").select("root", F.format_string("组%03d", "no_").alias("group_id"))
    member = written(photos.select("idx", "hash", score).join(roots, "idx"))
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"), F.min_by("hash", "idx").alias("first_"))
    out = ranked_members(member, score, "group_rank").join(sizes, "root").join(numbers, "root")
    out = out.withColumns({"similarity_score": F.round(F.greatest(F.lit(0.0), 1.0 - S.hamming(F.col("first_"), F.col("hash")) / 64.0), 4)})
    return out.select("idx", "root", "group_id", "group_size", "group_rank", (F.col("group_rank") == 1).alias("is_best"), "similarity_score")


def relative_quality(groups: DataFrame) -> DataFrame:
    return groups.withColumn("relative_quality", F.round((F.col("group_size") - F.col("group_rank") + 1) / F.col("group_size") * 100, 2))


def keep_top(groups: DataFrame, least: int = 1, most: int = 3) -> DataFrame:
    return groups.withColumn("recommended_keep", F.col("group_rank") <= min(most, max(least, 1)))


def set_status(photos: DataFrame, choices: DataFrame, at: Column | None = None) -> DataFrame:
    """Applies human choices (path, status; one a group) to whole groups."""
    when_ = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    own = choices.select("path", F.col("status").alias("want_"))
    chosen = photos.join(own, "path").where(~S.blank(F.col("similar_group_id"))).select("similar_group_id", F.col("path").alias("target_"), "want_")
    both = photos.join(chosen, "similar_group_id", "left")
    target = F.coalesce(F.col("path") == F.col("target_"), F.lit(False))
    want, best = F.coalesce(F.col("want_"), F.lit("")), F.coalesce(F.col("want_") == "best", F.lit(False))
    status = F.coalesce(F.col("similar_group_status"), F.lit(""))
    follower = best & ~target & ~status.isin("duplicate", "rejected") & (F.coalesce(F.col("review_status"), F.lit("")) != V.CONFIRMED)
    duplicate = target & (want == "duplicate")
    new_status = F.when(target & want.isin("best", "backup", "duplicate", "review"), want).when(follower, S.filled(status, "backup")).otherwise(status)
    new_best = F.when(best, target).otherwise(F.coalesce(F.col("best_in_group"), F.lit(False)))
    rating = F.when(target & S.blank(F.col("quality_rating")) & (want == "backup"), "B").when(duplicate & S.blank(F.col("quality_rating")), "C").otherwise(F.col("quality_rating"))
    decision = F.to_json(F.struct(F.col("similar_group_id"), new_status.alias("similar_group_status"), new_best.alias("best_in_group"), F.lit("human").alias("decision_source"), when_.alias("updated_at"), F.coalesce(F.col("similar_group_note"), F.lit("")).alias("note")))
    out = both.select(
        *(F.col(c) for c in photos.columns if c not in _DECIDED), new_status.alias("similar_group_status"), new_best.alias("best_in_group"), rating.alias("quality_rating"),
        F.when(best, target).otherwise(F.col("recommended_keep")).alias("recommended_keep"),
        F.when(target & want.isin("best", "backup", "duplicate"), V.CONFIRMED).when(target & (want == "review"), V.NEEDS_REVIEW).otherwise(F.col("review_status")).alias("review_status"),
        F.when(duplicate, S.append_once(F.col("issue_tags"), "重复照片")).otherwise(F.col("issue_tags")).alias("issue_tags"),
        F.when(duplicate, S.append_once(F.col("delivery_use"), V.NO_EXPORT)).otherwise(F.col("delivery_use")).alias("delivery_use"),
        F.when(target, decision).otherwise(F.col("human_group_decision")).alias("human_group_decision"),
    )
    return out.select(*photos.columns)


_DECIDED = {"similar_group_status", "best_in_group", "quality_rating", "recommended_keep", "review_status", "issue_tags", "delivery_use", "human_group_decision"}


def kept_boxes(boxes: Column, limit: float = 0.35) -> Column:
    """Boxes (x, y, w, h), largest first, that overlap no kept one by limit or more."""
    order = F.array_sort(F.transform(boxes, lambda b, n: F.struct((-(b["w"] * b["h"])).alias("a"), n.alias("n"), b.alias("b"))))
    start = F.slice(boxes, 1, 0)
    return F.aggregate(order, start, lambda kept, x: F.when(F.forall(kept, lambda k: S.box_iou(x["b"], k) < limit), F.concat(kept, F.array(x["b"]))).otherwise(kept))
