"""Search, union, scoring, balancing, selection and assignment of candidates.

A candidate row carries ``plan_id, scene_idx, query_idx, query, pos`` (place in
the provider's answer), ``provider_rank``, ``source, kind, title, description,
download_url, width, height, license`` and ``cand_id``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import classify as C
from ..functions.media import clamp, dot
from ..functions.lexicon import any_of
from ..functions.text import blank, fx_tokens, let, title_similarity, tokens
from .blocks import BLOCK, checkpoint, dense_pos, ordered_fold
from .validate import hard_reject

SCENE = ["plan_id", "scene_idx"]
STOCK = ("pexels", "pixabay")


TOGETHER = 2048  # queries that one pass over the library answers, and files that are scored at a time
HITS = 1 << 21  # pairs of a file and a query that share a token, of those that are added up at a time
NAME_TOKEN = r"(?U)[a-z0-9[\w&&[^_]]]+"  # tokens of lower-cased names, in which _ and - part words; the common characters are tried first


def search_library(queries: DataFrame, library: DataFrame, k: int = 12) -> DataFrame:
    """Top ``k`` library files per query by shared tokens of name and folders.

    ``queries`` has ``query_id, query``; ``library`` has ``cand_id, name, folders, kind``. Files that share no token fill up the tail, ties go to the
    smaller ``cand_id``. Returns ``query_id, place, cand_id, score``.

    Queries go in groups of bounded size. Each group travels to the files as an inverted index: every file adds up what its tokens are worth to each
    query, so a token that all files hold makes no rows, and a task hands on its best ``k`` files of each query.
    """
    bonus = F.when(F.col("kind") == "video", 2.5).otherwise(0.0)
    # words of a name may repeat: those that no query has are dropped and the rest made distinct beside the index
    named = F.regexp_extract_all(F.lower(blank(F.col("name"))), F.lit(NAME_TOKEN), F.lit(0))
    files = library.select("cand_id", bonus.alias("base"), named.alias("nt"), tokens(F.col("folders")).alias("ft"))
    asks = checkpoint(queries.select("query_id", tokens(F.col("query")).alias("qt")))
    groups = max(1, -(-asks.count() // TOGETHER))
    asks = asks.withColumn("__group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    schema = T.StructType([asks.schema["query_id"], files.schema["cand_id"], T.StructField("score", T.DoubleType())])
    best = None
    for g in range(groups):
        part = files.mapInArrow(_library_scores(asks.filter(F.col("__group") == g).select("query_id", "qt").toArrow(), k), schema)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_id", "place", "cand_id", "score")


def _library_scores(asks: pa.Table, k: int):
    """A scorer of files (cand_id, base, nt, ft) that yields the best k of each query among those it has seen."""
    ids = asks.column("query_id").to_pylist()
    wanted = asks.column("qt").combine_chunks()
    coded = wanted.flatten().dictionary_encode()
    vocabulary, codes = coded.dictionary, coded.indices.to_numpy()
    asking = np.repeat(np.arange(len(ids)), pc.list_value_length(wanted).fill_null(0).to_numpy())
    holders = asking[np.argsort(codes, kind="stable")]  # queries of each token, one token after the other
    counts = np.bincount(codes, minlength=len(vocabulary))
    starts = np.cumsum(counts) - counts

    def shared(column: pa.ListArray) -> np.ndarray:
        """How many tokens each query (rows) shares with each file (columns)."""
        out = np.zeros(len(ids) * len(column), np.int64)
        found = pc.index_in(column.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
        at = np.flatnonzero(found >= 0)
        file = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy())[at]
        file, token = np.divmod(np.unique(file * len(vocabulary) + found[at]), max(1, len(vocabulary)))
        ends = np.cumsum(counts[token])
        first = 0
        while first < len(token):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + HITS, "right")))
            n = counts[token[first:last]]
            place = np.arange(ends[last - 1] - done) + np.repeat(starts[token[first:last]] - (ends[first:last] - n - done), n)
            out += np.bincount(holders[place] * len(column) + np.repeat(file[first:last], n), minlength=len(out))
            first = last
        return out.reshape(len(ids), len(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple]] = [[] for _ in ids]
        bar = np.full(len(ids), -np.inf)

        def take(part: pa.RecordBatch) -> None:
            names, base = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
            scores = base + 8.0 * shared(part.column(2)) + 2.0 * shared(part.column(3))
            for q in np.flatnonzero(scores.max(axis=1) >= bar):
                row = scores[q]
                at = np.flatnonzero(row >= bar[q])
                if len(at) > k:  # more than enough: what lies below the k-th of these cannot stay
                    at = at[row[at] >= np.partition(row[at], -k)[-k]]
                top[q] = heapq.nsmallest(k, top[q] + [(-float(row[f]), names[f]) for f in at])
                if len(top[q]) == k:
                    bar[q] = -top[q][-1][0]

        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                take(batch.slice(start, TOGETHER))
        rows = [(ids[q], name, -score) for q, found in enumerate(top) for score, name in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], asks.schema.field("query_id").type), *(pa.array([r[i] for r in rows]) for i in (1, 2))], names=["query_id", "cand_id", "score"])

    return run


def union_providers(*tables: DataFrame, keys: list[str] = SCENE, want_video: Column | None = None) -> DataFrame:
    """Candidates of all providers; of one URL the first by provider and place.

    ``want_video`` (a condition on the row) admits stock videos.
    """
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t, allowMissingColumns=True)
    if want_video is not None:
        all_ = all_.filter(want_video | (F.col("kind") != "video") | ~F.col("source").isin(*STOCK))
    rest = [c for c in all_.columns if c not in (*keys, "download_url")]
    one = all_.filter(F.length("download_url") > 0).groupBy(*keys, "download_url").agg(
        F.min_by(F.struct(*rest), F.struct("provider_rank", "pos")).alias("r")
    )
    return one.select(*keys, "download_url", "r.*")


def lexical_score(title: Column, description: Column, wanted: Column, width: Column, height: Column, license_: Column) -> Column:
    """Metadata relevance: shared tokens with title and description, size, shape, licence."""
    ratio = width / height
    return (
        F.size(F.array_intersect(wanted, tokens(title))) * 7.0
        + F.size(F.array_intersect(wanted, tokens(description))) * 2.5
        + F.when((width >= 1200) | (height >= 1200), 2.5).when((width >= 800) | (height >= 800), 1.0).otherwise(0.0)
        + F.when((width == 0) | (height == 0), 0.0).otherwise(F.when(ratio.between(0.45, 0.8), 3.5).when(ratio <= 1.1, 1.5).otherwise(0.0))
        + F.when(F.length(blank(license_)) > 0, 0.5).otherwise(0.0)
    )


def mode_bonus(mode: Column, source: Column, kind: Column) -> Column:
    return (
        F.when(mode == "video", F.when(kind == "video", 18.0).otherwise(-5.0))
        .when(mode == "image", F.when(kind == "image", 4.0).otherwise(-1.0))
        .when(mode == "meme", F.when(source == "local_meme", 30.0).otherwise(-10.0))
        .otherwise(0.0)
    )


def source_bonus(mode: Column, source: Column, kind: Column) -> Column:
    return (
        F.when(mode == "historical_archive", F.when(source == "commons", 30.0).when(source == "openverse", 16.0).otherwise(-100.0))
        .when(mode == "stock_video", F.when(source.isin(*STOCK) & (kind == "video"), 22.0).otherwise(2.0))
        .when(mode == "meme_library", F.when(source == "local_meme", 100.0).otherwise(-100.0))
        .when(mode == "generic_image", F.when(kind == "image", 8.0).otherwise(-10.0))
        .otherwise(0.0)
    )


def lock_bonus(locked: Column, entities: Column, context: Column, title: Column, description: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", blank(title), blank(description)))
    held = lambda t: F.contains(hay, t)
    by_entity = F.aggregate(
        F.transform(entities, lambda e: F.when(F.forall(tokens(e), held), 14.0).otherwise(-8.0)), F.lit(0.0), lambda s, v: s + v
    )
    by_context = F.aggregate(
        F.transform(context, lambda c: F.when(F.exists(tokens(c), held), 5.0).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v
    )
    return F.when(locked, by_entity + by_context).otherwise(0.0)


def repeat_penalty(title: Column, used_titles: Column) -> Column:
    """Penalty for a title close to one of the last four used titles."""
    return title_similarity(title, _last_four(used_titles)) * 24.0


def _last_four(titles: Column) -> Column:
    return F.when(F.size(titles) > 4, F.slice(titles, -4, 4)).otherwise(titles)


def rank_pool(scenes: DataFrame, candidates: DataFrame, used_urls: DataFrame | None = None, top: int | None = None, local: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of each scene, one row per URL.

    ``local`` holds library files as ``local_library_pool`` gives them: they join the pool ahead of equal scores, and a scene that wants the
    library only and is not locked takes nothing else when it has some.

    ``scenes`` has ``plan_id, scene_idx, visual_mode, source_mode, semantic_lock,
    required_entities, required_context, visual_description`` and ``used_titles``
    (titles already registered in the plan). Adds ``score`` and ``place``. ``top``
    keeps the first places only, for the callers that look no further.
    """
    c = candidates
    if used_urls is not None:
        c = c.join(used_urls.select("plan_id", F.col("url").alias("download_url")).distinct(), ["plan_id", "download_url"], "left_anti")
    s = scenes.select(
        *SCENE, "visual_mode", "source_mode", "semantic_lock", "required_entities", "required_context",
        F.coalesce("visual_description", F.lit("")).alias("wish"), _last_four(F.col("used_titles")).alias("recent"),
    )
    j = c.join(s, SCENE).filter(C.source_allowed(F.col("semantic_lock"), F.col("source_mode"), F.col("source"), F.col("kind")))
    j = j.withColumn("__same", title_similarity(F.col("title"), F.col("recent"))).filter(F.col("semantic_lock") | (F.col("__same") < 0.86))
    wanted = tokens(F.concat_ws(" ", "query", "wish"))
    score = (
        lexical_score(F.col("title"), F.col("description"), wanted, F.col("width"), F.col("height"), F.col("license"))
        + mode_bonus(F.col("visual_mode"), F.col("source"), F.col("kind"))
        + source_bonus(F.col("source_mode"), F.col("source"), F.col("kind"))
        + lock_bonus(F.col("semantic_lock"), F.col("required_entities"), F.col("required_context"), F.col("title"), F.col("description"))
        - F.col("query_idx") * 0.28
        - F.col("__same") * 24.0
    )
    stock_only = (F.col("visual_mode") == "video") & (F.col("source_mode") == "stock_video")
    j = j.withColumn("score", F.round(score, 9)).withColumn("__stock_only", stock_only)
    row = F.struct(*[x for x in c.columns if x not in (*SCENE, "download_url")], "score", "__stock_only")
    best = j.groupBy(*SCENE, "download_url").agg(
        F.max_by(row, F.struct("score", -F.col("query_idx"), -F.col("pos"))).alias("r"), F.min(F.struct("query_idx", "pos")).alias("__first")
    )
    best = best.select(*SCENE, "download_url", "r.*", "__first")
    is_stock = (F.col("kind") == "video") & F.col("source").isin(*STOCK)
    # over a window of the scene, as the places below, so that no candidate is scored twice
    has = F.max(F.coalesce(F.col("__stock_only") & is_stock, F.lit(False))).over(Window.partitionBy(*SCENE))
    best = best.withColumn("__has", has).filter(is_stock | ~F.col("__has"))
    if local is not None:
        only = scenes.filter("source_mode = 'meme_library' and not semantic_lock").select(*SCENE).join(local.select(*SCENE).distinct(), SCENE)
        best = best.join(only, SCENE, "left_anti")
        first = F.struct(F.lit(-1).cast(c.schema["query_idx"].dataType).alias("query_idx"), F.col("pos").cast(c.schema["pos"].dataType).alias("pos")).alias("__first")
        known = set(local.columns)
        own = [F.col(x) if x in known and x != "pos" else F.lit(None).cast(best.schema[x].dataType).alias(x) for x in best.columns if x not in ("__first", "pos")]
        best = best.unionByName(local.select(*own, F.col("pos").cast(c.schema["pos"].dataType).alias("pos"), first))
    return _placed(best, top)


def _placed(pool: DataFrame, top: int | None) -> DataFrame:
    order = Window.partitionBy(*SCENE).orderBy(F.desc("score"), "__first")
    ranked = pool.withColumn("place", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("place") <= top)
    return ranked.drop("__first", "__has", "__stock_only")


def local_library_pool(scenes: DataFrame, hits: DataFrame) -> DataFrame:
    """Local library files as candidates of unlocked meme scenes: 30 + search score, 100 more for the named file, which also goes first among equals.

    ``scenes`` has ``visual_mode, source_mode, semantic_lock, meme_filename``; ``hits`` is the library search of each scene: ``plan_id, scene_idx, place,
    cand_id, path, file_name, title, kind, size, score``.
    """
    wants = ((F.col("visual_mode") == "meme") | (F.col("source_mode") == "meme_library")) & ~F.col("semantic_lock")
    j = hits.join(scenes.filter(wants).select(*SCENE, "meme_filename"), SCENE)
    named = F.coalesce(F.col("file_name") == F.col("meme_filename"), F.lit(False))
    return j.select(
        *SCENE, "cand_id", F.concat(F.lit("local:"), "path").alias("download_url"), F.lit("local meme library").alias("query"), F.lit("local_meme").alias("source"), "kind", "title",
        F.lit("").alias("description"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("local user library").alias("license"), "size",
        (30.0 + F.col("score") + F.when(named, 100.0).otherwise(0.0)).alias("score"), F.when(named, 0).otherwise(F.col("place")).alias("pos"),
    )


def recovery_pool(scenes: DataFrame, candidates: DataFrame, used_urls: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Candidates of the recovery queries; of one URL the first one wins.

    ``scenes`` has ``visual_mode, caption, used_titles``.
    """
    c = candidates
    if used_urls is not None:
        c = c.join(used_urls.select("plan_id", F.col("url").alias("download_url")).distinct(), ["plan_id", "download_url"], "left_anti")
    s = scenes.select(*SCENE, "visual_mode", blank(F.col("caption")).alias("wish"), _last_four(F.col("used_titles")).alias("recent"))
    fits = F.when(F.col("visual_mode") == "image", F.col("kind") == "image").when(
        F.col("visual_mode") == "video", F.col("kind").isin("video", "image")
    ).otherwise(True)
    j = c.join(s, SCENE).filter(fits).withColumn("__same", title_similarity(F.col("title"), F.col("recent"))).filter("__same < 0.9")
    wanted = tokens(F.concat_ws(" ", "query", "wish"))
    score = (
        lexical_score(F.col("title"), F.col("description"), wanted, F.col("width"), F.col("height"), F.col("license"))
        + mode_bonus(F.col("visual_mode"), F.col("source"), F.col("kind")) - F.col("__same") * 24.0
    )
    j = j.withColumn("score", F.round(score, 9)).withColumn("__first", F.struct("query_idx", "pos"))
    row = F.struct(*[x for x in c.columns if x not in (*SCENE, "download_url")], "score", "__first")
    best = j.groupBy(*SCENE, "download_url").agg(F.min_by(row, "__first").alias("r")).select(*SCENE, "download_url", "r.*")
    return _placed(best, top)


def round_robin(items: DataFrame, keys: list[str], bucket: str, pos: str, k: int, per_bucket: int | None = None) -> DataFrame:
    """Interleave the buckets of each key by position until ``k`` rows; adds ``place``.

    Buckets take turns in the order of their first row.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(pos)
    depth = min(per_bucket or k, k)
    ranked = items.withColumn("__rn", F.row_number().over(inside)).filter(F.col("__rn") <= depth)
    firsts = items.groupBy(*keys, bucket).agg(F.min(pos).alias("__first"))
    ranked = ranked.join(firsts, [*keys, bucket])
    order = Window.partitionBy(*keys).orderBy("__rn", "__first")
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("__rn", "__first")


def stock_candidates(items: DataFrame, used_urls: DataFrame | None = None, k: int = 24, per_query: int = 8, queries: int = 3) -> DataFrame:
    """Balanced pool of stock videos: sources take turns within a query, queries follow each other.

    A URL taken for an earlier query, or earlier in the turns of the same one, is not
    offered again; its place in its source still counts.
    """
    left = items.filter((F.length("download_url") > 0) & (F.col("query_idx") < queries))
    if used_urls is not None:
        left = left.join(used_urls.select("plan_id", F.col("url").alias("download_url")).distinct(), ["plan_id", "download_url"], "left_anti")
    taken = None
    for q in range(queries):
        own = left.filter(F.col("query_idx") == q)
        if taken is not None:
            own = own.join(taken.select(*SCENE, "download_url"), [*SCENE, "download_url"], "left_anti")
        firsts = own.groupBy(*SCENE, "source").agg(F.min("pos").alias("__first"))
        place = F.row_number().over(Window.partitionBy(*SCENE, "source").orderBy("pos"))
        turns = own.withColumn("__rn", place).join(firsts, [*SCENE, "source"]).withColumn("__o", F.struct("__rn", "__first"))
        once = turns.groupBy(*SCENE, "download_url").agg(F.min_by(F.struct(*own.columns), "__o").alias("__r"), F.min("__o").alias("__o"))
        got = once.select("__r.*", "__o").withColumn("turn", F.row_number().over(Window.partitionBy(*SCENE).orderBy("__o")))
        got = got.filter(F.col("turn") <= per_query).drop("__o")
        taken = got if taken is None else taken.unionByName(got)
    order = Window.partitionBy(*SCENE).orderBy("query_idx", "turn")
    return taken.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def pick_pexels_file(files: Column) -> Column:
    """Best file to download: portrait first, then resolution; null without a link."""
    w = lambda f: F.coalesce(f["width"], F.lit(0))
    h = lambda f: F.coalesce(f["height"], F.lit(0))

    def score(f: Column) -> Column:
        ratio = w(f) / h(f)
        shape = F.when(ratio < 0.8, 8.0).when(ratio < 1.0, 3.0).otherwise(0.0)
        pixels = F.least(w(f), F.lit(1920)) * F.least(h(f), F.lit(1920)) / 1_000_000
        return F.when((w(f) <= 0) | (h(f) <= 0), -1000.0).otherwise(
            shape + pixels - F.when(F.greatest(w(f), h(f)) > 2160, 2.0).otherwise(0.0)
        )

    ranked = F.transform(files, lambda f, i: F.struct(F.when(F.length(f["link"]) > 0, score(f)).alias("s"), (-i).alias("o"), f.alias("f")))
    return F.array_max(F.filter(ranked, lambda r: r["s"].isNotNull()))["f"]


def smallest_variant(files: Column, link: str) -> Column:
    """Smallest usable file of a list, for previews."""
    w = lambda f: F.coalesce(f["width"], F.lit(0))
    h = lambda f: F.coalesce(f["height"], F.lit(0))
    usable = F.filter(files, lambda f: F.coalesce(F.length(f[link]) > 0, F.lit(False)) & ((w(f) > 0) & (h(f) > 0) if link == "link" else F.lit(True)))
    ranked = F.transform(usable, lambda f, i: F.struct((w(f) * h(f)).alias("p"), F.greatest(w(f), h(f)).alias("l"), i.alias("o"), f.alias("f")))
    return F.array_min(ranked)["f"]


def pick_pixabay_variant(variants: Column) -> Column:
    """Best of the named variants, given as an array in the order medium, small, large, tiny."""
    w = lambda f: F.coalesce(f["width"], F.lit(0))
    h = lambda f: F.coalesce(f["height"], F.lit(0))
    usable = F.filter(variants, lambda f: F.coalesce(F.length(f["url"]) > 0, F.lit(False)))
    ranked = F.transform(usable, lambda f, i: F.struct((h(f) >= w(f)).alias("t"), (w(f) * h(f)).alias("p"), (-i).alias("o"), f.alias("f")))
    return F.array_max(ranked)["f"]


def cosine_scores(prompts: DataFrame, items: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Similarity of each item to the prompts of its key, every pair a row; items without a vector score 0.

    ``prompts`` has the keys, ``prompt_id, embedding``; ``items`` the keys,
    ``item_id, embedding``; vectors have unit length. ``top_cosine`` and ``pooled_cosine`` give the best and the pooled scores without the pairs.
    """
    p = prompts.select(*keys, "prompt_id", F.col("embedding").alias("__p"))
    i = items.select(*keys, "item_id", F.col("embedding").alias("__i"))
    score = F.when(F.col("__i").isNotNull(), dot(F.col("__p"), F.col("__i"))).otherwise(0.0)
    return i.join(p, keys).select(*keys, "prompt_id", "item_id", F.round(score, digits).alias("score"))


SIDE = 512  # prompts, and items, of a cell of the grid, on average


def _cell_products(prompts: DataFrame, items: DataFrame, keys: list[str], group: str, reduce, out: list[T.StructField], together: bool = True) -> DataFrame:
    """Prompts and items of a key in a grid of blocks; each cell is one matrix product, of which ``reduce(prompt ids, item ids, groups, scores)`` keeps columns.

    Items of one ``group`` meet in one block, unless ``together`` is false. A key of any size is spread over its cells; a vector is copied once for each block of the other side.
    """
    sizes = prompts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("__np")).join(
        items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("__ni")), keys
    )
    sizes = checkpoint(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    p = prompts.join(sizes, keys).select(*keys, own("prompt_id", "__np").alias("__pb"), every("__ni").alias("__ib"), "prompt_id", "embedding")
    i = items.join(sizes, keys).select(*keys, every("__np").alias("__pb"), own(group if together else "item_id", "__ni").alias("__ib"), "item_id", F.col(group).alias("__g"), "embedding")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        rows = column.to_pylist()
        width = max((len(r) for r in rows if r is not None), default=0)
        return np.array([r if r is not None else [0.0] * width for r in rows], float).reshape(len(rows), width)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema_of.empty_table()
        a, b = matrix(left.column("embedding")), matrix(right.column("embedding"))
        scores = a @ b.T if a.shape[1] == b.shape[1] else np.zeros((len(a), len(b)))
        columns = reduce(left.column("prompt_id"), right.column("item_id"), right.column("__g"), scores)
        n = len(columns[0])
        return pa.Table.from_arrays([*(pa.array([left.column(k)[0].as_py()] * n, left.schema.field(k).type) for k in keys), *columns], schema=schema_of)

    schema = T.StructType([*(items.schema[k] for k in keys), *out])
    schema_of = to_arrow_schema(schema)
    where = [*keys, "__pb", "__ib"]
    return p.groupBy(*where).cogroup(i.groupBy(*where)).applyInArrow(run, schema)


def top_cosine(prompts: DataFrame, items: DataFrame, keys: list[str], k: int, digits: int = 6) -> DataFrame:
    """The ``k`` most similar items of each prompt among those of its key: ``prompt_id, place, item_id, score``; ties go to the smaller ``item_id``.

    Vectors as in ``cosine_scores``. Each cell of the grid hands on its best ``k`` of each prompt, never the pairs.
    """

    def reduce(prompt_ids, item_ids, groups, scores):
        rounded = np.round(scores, digits) + 0.0
        by_id = np.argsort(np.array(item_ids.to_pylist(), dtype=object), kind="stable")
        best = by_id[np.argsort(-rounded[:, by_id], axis=1, kind="stable")[:, :k]]
        rows, at = np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()
        return [prompt_ids.combine_chunks().take(pa.array(rows)), item_ids.combine_chunks().take(pa.array(at)), pa.array(rounded[rows, at])]

    found = _cell_products(prompts, items, keys, "item_id", reduce, [prompts.schema["prompt_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())])
    order = Window.partitionBy("prompt_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(*keys, "prompt_id", "place", "item_id", "score")


def pooled_cosine(prompts: DataFrame, frames: DataFrame, keys: list[str], candidate: str, digits: int = 6) -> DataFrame:
    """``visual`` of each candidate for the prompts of its key: 0.72 of its best and 0.28 of its mean frame score (see ``pool_frames``).

    All frames of a candidate lie in one block, so a cell pools them at once and no row stands for a single frame.
    """

    def reduce(prompt_ids, item_ids, groups, scores):
        rounded = np.round(scores, digits) + 0.0
        names = groups.combine_chunks().dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        counts = np.diff(np.append(starts, len(order)))
        visual = np.maximum.reduceat(rounded[:, order], starts, axis=1) * 0.72 + np.add.reduceat(rounded[:, order], starts, axis=1) / counts * 0.28
        rows, at = np.repeat(np.arange(len(scores)), len(starts)), np.tile(of[order][starts], len(scores))
        return [prompt_ids.combine_chunks().take(pa.array(rows)), names.dictionary.take(pa.array(at)), pa.array(visual.ravel())]

    return _cell_products(prompts, frames, keys, candidate, reduce, [prompts.schema["prompt_id"], frames.schema[candidate], T.StructField("visual", T.DoubleType())])


def best_cosine(prompts: DataFrame, items: DataFrame, keys: list[str], group: str, digits: int = 6) -> DataFrame:
    """``score`` of the most similar item of each ``group`` for each prompt of its key; no row stands for a single item."""

    def reduce(prompt_ids, item_ids, groups, scores):
        names = groups.combine_chunks().dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        best = np.maximum.reduceat(np.round(scores, digits)[:, order] + 0.0, starts, axis=1)
        rows, at = np.repeat(np.arange(len(scores)), len(starts)), np.tile(of[order][starts], len(scores))
        return [prompt_ids.combine_chunks().take(pa.array(rows)), names.dictionary.take(pa.array(at)), pa.array(best.ravel())]

    out = [prompts.schema["prompt_id"], items.schema[group], T.StructField("score", T.DoubleType())]
    cells = _cell_products(prompts, items, keys, group, reduce, out, together=False)
    return cells.groupBy(*keys, "prompt_id", group).agg(F.max("score").alias("score"))


def title_overlap(title: Column, wanted: Column) -> Column:
    """Share of the wanted tokens that a title holds; 0 when nothing is wanted."""
    return let(
        tokens(wanted), lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, tokens(title))) / F.greatest(F.lit(1), F.size(w))).otherwise(0.0)
    )


def blend_scores(rows: DataFrame) -> DataFrame:
    """0.62 specific + 0.34 primary + 0.04 title overlap, ranked per scene; ties go to the higher id.

    Needs ``candidate, primary, specific`` (may be null), and ``title, wanted`` or their ``title_overlap`` as ``lexical``, for callers
    with many rows of one title.
    """
    lexical = F.col("lexical") if "lexical" in rows.columns else title_overlap(F.col("title"), F.col("wanted"))
    score = F.coalesce("specific", "primary") * 0.62 + F.col("primary") * 0.34 + lexical * 0.04
    order = Window.partitionBy(*SCENE).orderBy(F.desc("score"), F.desc("candidate"))
    return rows.withColumn("score", F.round(score, 9)).withColumn("place", F.row_number().over(order))


def pool_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Visual score of a video from its frame scores: 0.72 best + 0.28 mean."""
    return frames.groupBy(*keys).agg((F.max("score") * 0.72 + F.avg("score") * 0.28).alias("visual"))


def video_rerank(pool: DataFrame, visual: DataFrame | None, keys: list[str]) -> DataFrame:
    """Videos with a visual score follow it; videos nobody looked at drop below -100.

    ``visual`` has the keys and ``visual``; with None, the pool has that column itself.
    """
    j = pool if visual is None else pool.join(visual, keys, "left")
    score = (
        F.when(F.col("kind") != "video", F.col("score"))
        .when(F.col("visual").isNotNull(), F.col("score") * 0.20 + F.col("visual") * 100.0)
        .otherwise(F.least("score", F.lit(-100.0)))
    )
    return j.withColumn("score", score)


def first_images(pool: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """The first ``k`` images by ``place`` of each key."""
    order = Window.partitionBy(*keys).orderBy("place")
    return pool.filter("kind = 'image'").withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k).drop("__n")


def semantic_boost(pool: DataFrame, similarity: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """Add 28 x similarity to the first ``k`` images of each scene.

    ``pool`` has the ``place`` of each row; ``similarity`` the keys and ``sim``.
    """
    gain = first_images(pool, SCENE, k).join(similarity, keys).select(*keys, "sim")
    return boosted(pool.join(gain, keys, "left"))


def boosted(pool: DataFrame) -> DataFrame:
    """Scores with the gain of a row's ``sim``, where it has one."""
    return pool.withColumn("score", F.col("score") + F.coalesce(F.col("sim"), F.lit(0.0)) * 28.0)


def fit_of(score: Column) -> Column:
    """Whole-number fit of a similarity; 42 when the candidate was not scored."""
    return F.coalesce(F.floor(clamp((score + 0.10) * 190.0, 0.0, 100.0)), F.lit(42)).cast("int")


def assign_unique(rankings: DataFrame, used_urls: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Each scene, in order, takes its best URL that no earlier scene of the plan took.

    ``rankings`` has ``plan_id, scene_idx, place, cand_id, url, score``; unscored
    candidates come last and keep a null score. Returns the chosen rows with ``fit``.
    """
    r = rankings
    if used_urls is not None:
        r = r.join(used_urls.select("plan_id", "url").distinct(), ["plan_id", "url"], "left_anti")
    option = F.struct("place", "cand_id", "url", "score")
    lists = r.groupBy(*SCENE).agg(F.sort_array(F.collect_list(option)).alias("options"))
    counts = lists.groupBy("plan_id").agg(F.count(F.lit(1)).alias("__n"))
    long = counts.filter(F.col("__n") >= size).select("plan_id")
    has_long = not long.limit(1).isEmpty()
    short = lists.join(long, "plan_id", "left_anti") if has_long else lists
    packed = short.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("scene_idx", "options"))).alias("rows"))

    def take(acc: Column, row: Column) -> Column:
        def chosen(o: Column) -> Column:
            grown = F.array_append(acc["out"], F.struct(row["scene_idx"].alias("scene_idx"), o.alias("o")))
            return F.when(o.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], o["url"]).alias("used"), grown.alias("out")))

        return let(F.try_element_at(F.filter(row["options"], lambda o: ~F.array_contains(acc["used"], o["url"])), F.lit(1)), chosen)

    kind = lists.schema["options"].dataType.elementType.simpleString()
    scene_type = dict(rankings.dtypes)["scene_idx"]
    zero = F.struct(
        F.array().cast("array<string>").alias("used"), F.array().cast(f"array<struct<scene_idx:{scene_type},o:{kind}>>").alias("out")
    )
    out = packed.select("plan_id", F.inline(F.aggregate("rows", zero, take)["out"])).select(*SCENE, "o.*")
    if has_long:
        out = out.unionByName(_assign_in_rounds(lists.join(long, "plan_id", "left_semi")))
    return out.withColumn("fit", fit_of(F.col("score")))


def _assign_in_rounds(lists: DataFrame) -> DataFrame:
    """The same assignment for long plans: scenes propose, each URL keeps the earliest scene.

    A scene that loses its URL moves to its next one. The order of scenes is the
    preference of every URL, so the final state is the sequential result.
    """
    fixed = checkpoint(lists)
    at = checkpoint(fixed.select(*SCENE, F.lit(1).alias("n")))
    while True:
        held = at.join(fixed, SCENE).select(*SCENE, "n", F.try_element_at("options", F.col("n")).alias("o"))
        held = held.filter("o is not null")
        owners = held.groupBy("plan_id", F.col("o.url").alias("url")).agg(F.min("scene_idx").alias("owner"), F.count(F.lit(1)).alias("c"))
        contested = owners.filter("c > 1")
        losers = held.withColumn("url", F.col("o.url")).join(contested, ["plan_id", "url"]).filter(F.col("scene_idx") > F.col("owner"))
        losers = checkpoint(losers.select(*SCENE, F.lit(1).alias("step")))
        if losers.isEmpty():
            return held.select(*SCENE, "o.*")
        at = checkpoint(at.join(losers, SCENE, "left").select(*SCENE, (F.col("n") + F.coalesce("step", F.lit(0))).alias("n")))


def refine_assignment(assigned: DataFrame, choices: DataFrame, candidates: DataFrame, size: int = BLOCK) -> DataFrame:
    """Let sanitized choices override the assignment when no other scene holds their URL.

    ``assigned`` has ``plan_id, scene_idx, url``; ``choices`` ``plan_id, scene_idx,
    candidate, fit, reply_pos`` (one per scene); ``candidates`` ``plan_id,
    scene_idx, candidate, url``. Returns the final ``plan_id, scene_idx, url, refined``.
    """
    wish = choices.filter((F.col("candidate") != 0) & (F.col("fit") >= 35)).join(candidates, [*SCENE, "candidate"])
    wish = wish.select(*SCENE, F.col("url").alias("want"), "reply_pos")
    both = assigned.select(*SCENE, "url").join(wish, SCENE, "full_outer")
    asked = both.filter("want is not null")
    # Only plans with a wish need the pass; a wish can clash only over URLs that somebody wants or holds.
    moves = dense_pos(asked, ["plan_id"], [F.col("reply_pos"), F.col("scene_idx")], F.floor(F.col("reply_pos") / F.lit(size)), "pos")
    held = assigned.join(asked.select("plan_id", F.col("want").alias("url")).distinct(), ["plan_id", "url"], "left_semi")
    start = held.groupBy("plan_id").agg(F.collect_list(F.struct("scene_idx", "url")).alias("start"))
    first = moves.filter("pos = 0").select("plan_id").join(start, "plan_id", "left").withColumn("pos", F.lit(0).cast("bigint"))
    moves = moves.join(first, ["plan_id", "pos"], "left")
    pair = "array<struct<scene_idx:int,url:string>>"

    def step(state: Column, r: Column):
        live = F.when(r["pos"] == 0, F.coalesce(r["start"].cast(pair), F.array().cast(pair))).otherwise(state["held"])

        def changed(h: Column) -> Column:
            taken = F.exists(h, lambda x: (x["url"] == r["want"]) & (x["scene_idx"] != r["scene_idx"]))
            moved = F.array_append(
                F.filter(h, lambda x: x["scene_idx"] != r["scene_idx"]),
                F.struct(r["scene_idx"].cast("int").alias("scene_idx"), r["want"].alias("url")),
            )
            return F.when(taken, h).otherwise(moved)

        free = ~F.exists(live, lambda x: (x["url"] == r["want"]) & (x["scene_idx"] != r["scene_idx"]))
        return {"held": let(live, changed)}, free, F.array(F.struct(r["scene_idx"].cast("int").alias("scene_idx"), r["want"].alias("url")))

    won = ordered_fold(moves, ["plan_id"], "pos", ["scene_idx", "want", "start"], {"held": (pair, [])}, step, "struct<scene_idx:int,url:string>", size)
    won = won.withColumnRenamed("url", "__won")
    out = assigned.select(*SCENE, "url").join(won, SCENE, "full_outer")
    return out.select(*SCENE, F.coalesce("__won", "url").alias("url"), F.col("__won").isNotNull().alias("refined"))


def judge_batches(rankings: DataFrame, top: int = 3, batch: int = 4, size: int = BLOCK) -> DataFrame:
    """Shortlist of each scene and the batch of scenes it is judged in."""
    short = rankings.filter(F.col("place") <= top)
    scenes = dense_pos(short.select(*SCENE).distinct(), ["plan_id"], [F.col("scene_idx")], F.floor(F.col("scene_idx") / F.lit(size)), "__n")
    return short.join(scenes, SCENE).withColumn("batch", F.floor(F.col("__n") / batch).cast("int")).drop("__n")


def select_best(
    pool: DataFrame, scenes: DataFrame, guard: DataFrame, judge: DataFrame | None = None, max_checks: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Best candidate of each scene after local guard, metadata check and judge.

    ``pool`` is ranked by ``place``; ``scenes`` has ``semantic_lock, tone`` and
    ``scene_text``; ``guard`` has ``cand_id, guard_score, issues`` (no row: the
    file could not be read); ``judge`` has gated replies per ``plan_id, scene_idx,
    cand_id``. Returns the chosen rows with ``combined`` and ``checks``, and the rejected rows.
    """
    s = scenes.select(*SCENE, "semantic_lock", "tone", "scene_text")
    j = pool.join(s, SCENE).join(guard.select("cand_id", "guard_score", "issues"), "cand_id")
    weak = (F.col("guard_score") < 38) | F.arrays_overlap("issues", F.array(F.lit("too_short"), F.lit("flat_gray_video")))
    conflict = C.metadata_conflict(F.col("semantic_lock"), F.col("scene_text"), F.concat_ws(" ", "title", "description"))
    j = j.withColumn("__out", F.when(weak, "local_quality").otherwise(conflict))
    order = Window.partitionBy(*SCENE).orderBy("place")
    seen = j.filter("__out is null").withColumn("__check", F.row_number().over(order)).filter(F.col("__check") <= max_checks)
    combined = F.col("score") + F.col("guard_score") * 0.035
    if judge is not None:
        reply = judge.select(*SCENE, "cand_id", F.struct("score", "tone_match", "quality_score", "accept", "mismatch").alias("__j"))
        seen = seen.join(reply, [*SCENE, "cand_id"], "left")
        g = F.col("__j")
        gain = g["score"] * 0.16 + g["tone_match"] * 0.075 + g["quality_score"] * 0.075 + F.when(g["accept"], 4.0).otherwise(-4.0)
        combined = combined + F.coalesce(gain, F.lit(-3.0))
        bad = hard_reject(F.col("tone"), F.col("semantic_lock"), g["accept"], g["score"], g["tone_match"], g["quality_score"], g["mismatch"])
        hard = F.col("__j").isNotNull() & bad
    else:
        hard = F.lit(False)
    seen = seen.withColumn("combined", F.round(combined, 9)).withColumn("__hard", F.coalesce(hard, F.lit(False)))
    keep = [c for c in pool.columns if c not in SCENE]
    best = seen.filter(~F.col("__hard")).groupBy(*SCENE).agg(
        F.max_by(F.struct(*keep, "combined"), F.struct("combined", -F.col("place"))).alias("r")
    )
    ends = seen.groupBy(*SCENE).agg(F.max("__check").cast("int").alias("checks"), F.max("place").alias("__stop"))
    chosen = best.join(ends, SCENE).select(*SCENE, "r.*", "checks")
    passed = j.filter("__out is not null").join(ends, SCENE, "left")
    passed = passed.filter((F.coalesce(F.col("checks"), F.lit(0)) < max_checks) | (F.col("place") < F.col("__stop")))
    cols = [*SCENE, "cand_id", "download_url", "place"]
    rejected = passed.select(*cols, F.col("__out").alias("reason"), (F.col("__out") != "local_quality").alias("hard"))
    if judge is not None:
        refused = seen.filter(F.col("__hard") | ~F.col("__j.accept"))
        rejected = rejected.unionByName(refused.select(*cols, F.lit("judge").alias("reason"), F.col("__hard").alias("hard")))
    return chosen, rejected


def fallback_ladder(scenes: DataFrame, guard: DataFrame, pools: dict[str, DataFrame], judges: dict[str, DataFrame] | None = None) -> DataFrame:
    """Exact, then close, then context candidates; the lower levels only for unlocked scenes still open.

    ``pools`` maps a level to its ranked pool. URLs rejected on one level are not
    tried again. Returns one row per scene with ``status, level, cand_id``.
    """
    judges = judges or {}
    todo, gone, found = scenes, None, None
    for level, checks in (("exact", 5), ("close", 4), ("context", 3)):
        if level not in pools:
            continue
        pool = pools[level].join(todo.select(*SCENE), SCENE, "left_semi")
        if gone is not None:
            pool = pool.join(gone, [*SCENE, "download_url"], "left_anti")
        chosen, rejected = select_best(checkpoint(pool), todo, guard, judges.get(level), checks)
        rejected, chosen = checkpoint(rejected), checkpoint(chosen)
        chosen = chosen.select(*SCENE, "cand_id", "download_url", "title", "combined", "checks").withColumn("level", F.lit(level))
        bad = rejected.filter("reason <> 'local_quality'").select(*SCENE, "download_url")
        gone = bad if gone is None else gone.unionByName(bad)
        found = chosen if found is None else found.unionByName(chosen)
        todo = checkpoint(todo.filter(~F.col("semantic_lock")).join(chosen.select(*SCENE), SCENE, "left_anti"))
    status = (
        F.when(F.col("level") == "exact", "downloaded")
        .when(F.col("level").isNotNull(), "downloaded_recovery")
        .when(F.col("semantic_lock"), "not_found_locked")
        .otherwise("not_found_recovery")
    )
    return scenes.join(found, SCENE, "left").withColumn("status", status)


def accept_choice(choices: DataFrame, guard: DataFrame) -> DataFrame:
    """First choice with fit 55 or more that passes the guard; else the best from 30 as an emergency.

    ``choices`` has ``plan_id, scene_idx, place, cand_id, fit``.
    """
    j = choices.join(guard.select("cand_id", "accept"), "cand_id").filter("accept and fit >= 30")
    good = F.col("fit") >= 55
    rank = F.struct((~good).cast("int"), F.when(good, F.col("place")).otherwise(-F.col("fit")), F.col("place"))
    one = j.groupBy(*SCENE).agg(F.min_by(F.struct("cand_id", "fit", "place"), rank).alias("r"))
    return one.select(*SCENE, "r.*", (F.col("r.fit") < 55).alias("emergency"))


def score_overlays(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay scores: a judge's reply when there is one, similarity otherwise.

    Needs ``base`` and ``judged, judge_score, judge_quality, judge_accept, sim``.
    """
    s = F.coalesce(F.col("judge_score").cast("double"), F.lit(50.0)) + F.col("base")
    q = F.coalesce(F.col("judge_quality").cast("double"), F.lit(50.0))
    no_reply = F.col("judge_score").isNull()
    ok = no_reply | (F.col("judge_accept") & (s >= 45) & (q >= 40))
    score = F.when(F.col("judged"), s * 0.68 + q * 0.32).otherwise(F.coalesce(F.col("sim") * 100.0, F.lit(0.0)) + F.col("base"))
    kept = rows.filter(~F.col("judged") | ok).withColumn("score", score)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")))


def best_sticker(scores: DataFrame, keys: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """Sticker most similar to each prompt, similarity above 0, outside the excluded ones.

    ``scores`` has the keys, ``asset`` and ``score``; the first asset by name wins ties.
    """
    s = scores.filter("score > 0")
    if excluded is not None:
        s = s.join(excluded, [c for c in excluded.columns], "left_anti")
    best = s.groupBy(*keys).agg(F.max("score").alias("score"))
    return s.join(best, [*keys, "score"]).groupBy(*keys, "score").agg(F.min("asset").alias("asset")).select(*keys, "asset", "score")


# Metadata that marks a picture as unfit for a cut-out, and words that favour one.
CUTOUT_REJECT = (
    "logo", "seal", "emblem", "badge", "flag", "coat of arms",
    "newspaper", "article", "document", "screenshot", "diagram",
    "chart", "map", "poster", "banner", "infographic", "symbol",
)
CUTOUT_STYLE = ("sticker", "cartoon", "funny", "cutout")
PARTS = 256  # parts that the candidates of one query are dealt into


def cutout_search(queries: DataFrame, candidates: DataFrame, keep: int = 8, fallback: int = 10) -> DataFrame:
    """Pictures for a foreground insert: the first transparent ones, else the first larger plain ones.

    ``queries`` has ``query_id, query``; ``candidates`` ``query_id, pos, title,
    description, mime, kind, download_url, width, height`` and ``cutout`` (real
    transparency by ``media.is_cutout``). Adds ``base`` (4 per query token found, 3 for style words) and ``cutout``.
    """
    key = ["query_id"]
    rest = [c for c in candidates.columns if c not in ("query_id", "download_url")]
    c = candidates.filter("kind = 'image' and length(download_url) > 0")
    c = c.groupBy(*key, "download_url").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(*key, "download_url", "r.*")
    meta = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("description"))))
    # Each query goes to every part of its candidates, so those of one query meet it in many tasks.
    parts = queries.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    c = c.filter(~any_of(meta, CUTOUT_REJECT)).withColumn("__part", F.pmod(F.xxhash64("download_url"), F.lit(PARTS)).cast("int"))
    j = c.join(parts, [*key, "__part"]).drop("__part")
    png = (F.col("mime") == "image/png") & (F.col("width") >= 240) & (F.col("height") >= 240) & F.col("cutout")
    plain = (F.col("width") >= 420) & (F.col("height") >= 320)
    overlap = F.size(F.filter(F.array_distinct(fx_tokens(F.col("query"))), lambda t: F.contains(meta, t))) * 4.0
    styled = F.when(png & any_of(meta, CUTOUT_STYLE), 3.0).otherwise(0.0)
    j = j.withColumn("base", overlap + styled).withColumn("cutout", F.coalesce(png, F.lit(False))).filter(png | plain)
    order = Window.partitionBy(*key, "cutout").orderBy("pos")
    ranked = j.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(keep, fallback))
    ranked = ranked.filter(F.col("place") <= F.when(F.col("cutout"), keep).otherwise(fallback))
    with_png = ranked.filter("cutout").select(*key).distinct().withColumn("__has", F.lit(True))
    return ranked.join(with_png, key, "left").filter(F.col("cutout") | F.col("__has").isNull()).drop("__has")
