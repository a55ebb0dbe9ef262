"""Albums by content, search by meaning, album names."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.functions.text import COMMON_WORDS, search_words, squeeze, title
from lumenlake.sources.scratch import materialise

# Names of screenshots and forwarded photos, receipt words, words that name no album.
SCREENSHOT_NAME = r"(?i)screen ?shot|screen[_-]?capture|scrnli"
FORWARDED_NAME = r"(?i)^(IMG-\d{8}-WA\d+|WhatsApp Image|photo_\d{4}-\d{2}-\d{2}|signal-\d{4})"
LOSSLESS = ("image/png", "image/webp", "image/bmp", "image/gif")
RECEIPT_PARTS = ("total", "subtotal", "amount", "invoice", "receipt", "qty", "cash", "change", "gst", "tax", "bill")
NOT_NAMES = (
    "total", "cash", "price", "time", "date", "open", "closed", "sale", "offer", "welcome", "exit", "entry", "street", "road", "this", "that", "your", "with", "from", "have",
    "will", "the", "and", "for", "you", "are", "not", "all", "our", "new", "get", "one", "two", "off", "per", "net", "qty",
)


#: Photos of one selection that one task counts the words of, and words of photos that a task counts in all; so many are counted at once.
PHOTOS_A_TASK, WORDS_A_TASK, STEP = 10_000, 8_000_000, 1 << 20


def best_scores(vector: str, sets: Sequence[np.ndarray]) -> Column:
    """array<double>: for each set of unit vectors the largest inner product with the row's vector (double precision)."""
    tables = [np.atleast_2d(np.asarray(s, dtype=float)) for s in sets]

    def run(rows: pd.Series) -> pd.Series:
        held = [v for v in rows if v is not None]
        if not held:
            return pd.Series([None] * len(rows), dtype=object)
        m = np.stack(held).astype(float)
        made = iter(np.stack([(m @ t.T).max(axis=1) for t in tables], axis=1))
        return pd.Series([None if v is None else next(made) for v in rows], dtype=object)

    return F.pandas_udf(run, "array<double>")(F.col(vector))


def is_screenshot(flat: float = 0.45) -> Column:
    plain = F.col("content_type").isin(*LOSSLESS) & F.col("taken_at").isNull() & (F.coalesce("flatness", F.lit(0.0)) >= flat)
    return F.coalesce(F.col("filename").rlike(SCREENSHOT_NAME) | plain, F.lit(False))


def is_document(score: Column, least: float = 0.035) -> Column:
    """Looks like one, or has twenty words, or two words that hold a receipt word. Screenshots are told apart by the caller."""
    words = F.filter(F.split(F.lower(F.coalesce("ocr_text", F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    cues = F.filter(words, lambda w: F.exists(F.array(*[F.lit(p) for p in RECEIPT_PARTS]), lambda p: F.contains(w, p)))
    return F.coalesce(score >= least, F.lit(False)) | (F.size(words) >= 20) | (F.size(cues) >= 2)


def is_meme(words: Column, tall: float = 0.05) -> Column:
    """Big words at the top and at the bottom, thirty words at most."""
    big = F.filter(words, lambda w: w["box"][3] >= tall)
    centre = F.transform(big, lambda w: w["box"][1] + w["box"][3] / 2)
    return F.coalesce(F.exists(centre, lambda y: y < 0.3) & F.exists(centre, lambda y: y > 0.7) & (F.size(words) <= 30), F.lit(False))


def is_forwarded(quality: int = 70, side: int = 1600) -> Column:
    small = (F.col("content_type") == "image/jpeg") & ~F.col("camera") & (F.col("jpeg_quality") <= quality) & (F.greatest("width", "height") <= side)
    return F.coalesce(F.col("filename").rlike(FORWARDED_NAME), F.lit(False)) | F.coalesce(small, F.lit(False))


def auto_albums(photos: DataFrame, faces: DataFrame, prompts: dict[str, np.ndarray], generic: np.ndarray, documents: np.ndarray, real: np.ndarray, least: float = 0.02) -> DataFrame:
    """album, id, score: members of every album; best first is score descending, then uploaded_at, then id.

    photos: the catalogue columns, `clip` (null: in no album but people) and `ocr_words`. prompts: a few unit
    vectors for each album (a bounded set). A photo of both `pets` and `animals` stays in the better one (pets on ties).
    """
    names = list(prompts)
    own = photos.where("clip is not null").withColumn("_s", best_scores("clip", [generic, documents, real, *prompts.values()]))
    fit = {n: F.col("_s")[k + 3] - F.col("_s")[0] for k, n in enumerate(names)}
    kept = {n: s >= least for n, s in fit.items()}
    if "pets" in fit and "animals" in fit:
        both, pets_win = kept["pets"] & kept["animals"], fit["pets"] >= fit["animals"]
        kept["pets"], kept["animals"] = kept["pets"] & ~(both & ~pets_win), kept["animals"] & ~(both & pets_win)
    document = F.col("_s")[1] - F.col("_s")[2]
    shot = is_screenshot()
    rules = [(n, kept[n], fit[n]) for n in names] + [
        ("documents", ~shot & is_document(document), document),
        ("screenshots", shot, F.coalesce("flatness", F.lit(0.0))),
        ("memes", ~shot & is_meme(F.col("ocr_words")), F.lit(1.0)),
        ("forwarded", is_forwarded(), 100.0 - F.coalesce("jpeg_quality", F.lit(100))),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(n).alias("album"), score.cast("double").alias("score"))) for n, rule, score in rules]))
    shown = own.select("id", F.explode(found).alias("a")).select("a.album", "id", "a.score")
    people = faces.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").cast("double").alias("score")).select(F.lit("people").alias("album"), "id", "score")
    return shown.unionByName(people)


def smart_search(photos: DataFrame, queries: list[tuple[str, str, np.ndarray]], generic: np.ndarray, least: float = 0.015, window: float = 0.045, bonus: float = 0.05) -> DataFrame:
    """query, id, score: for each (name, text, unit vector) the photos it describes clearly better than a generic caption.

    photos: id, clip, ocr_text; photos without a vector take no part. Photos within `window` of the query's best
    count, and all that show one of its words, which score higher. Best first is score descending, then id descending.
    The queries are a bounded set; photos are scored in Arrow batches and only qualifying pairs are shuffled.
    """
    spark = photos.sparkSession
    own = photos.where("clip is not null").withColumn("_s", best_scores("clip", [generic, *[v for _, _, v in queries]])).withColumn("_t", squeeze(F.coalesce("ocr_text", F.lit(""))))
    each = F.posexplode(F.slice("_s", 2, len(queries)))
    rows = own.select("id", "_t", F.col("_s")[0].alias("base"), each.alias("k", "s")).select("id", "_t", "k", (F.col("s") - F.col("base")).alias("score"))
    words = spark.createDataFrame([(k, n, t) for k, (n, t, _) in enumerate(queries)], "k int, query string, words string").withColumn("words", search_words(F.col("words")))
    rows = rows.join(F.broadcast(words), "k").withColumn("found", F.size(F.filter("words", lambda w: F.contains(F.col("_t"), w))))
    rows = rows.where((F.col("score") >= least) | (F.col("found") > 0)).select("query", "id", "score", "found", F.size("words").alias("n"))
    best = rows.groupBy("query").agg(F.max("score").alias("best"))
    hit = rows.join(F.broadcast(best), "query").where((F.col("found") > 0) | (F.col("score") >= F.greatest(F.lit(least), F.col("best") - window)))
    return hit.select("query", "id", (F.col("score") + F.when(F.col("found") > 0, bonus * F.col("found") / F.col("n")).otherwise(0.0)).alias("score"))


def suggest_album_names(selection: DataFrame, photos: DataFrame, auto: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """album_id, names: up to four for each selection (album_id, photo_id).

    Two words written on most photos (two photos at least, one for a single photo), the automatic album that
    holds half of them, the month or the year that all camera dates share. Ties: first seen by photo id and place.
    """
    chosen = materialise(selection.select("album_id", "photo_id").distinct(), "album-photos")
    # the words of a photo are found once, in however many selections it is; `o` is a word's place in the order of photo and place
    used = photos.select("id", "ocr_text").join(chosen.select(F.col("photo_id").alias("id")).distinct(), "id", "left_semi")
    word = used.select(F.col("id").alias("photo_id"), F.posexplode(F.regexp_extract_all(F.coalesce("ocr_text", F.lit("")), F.lit(r"[\p{L}\p{Nl}\p{No}]{3,}"), 0)).alias("at", "word"))
    word = word.withColumn("key", F.lower("word")).where(~F.col("key").isin(*COMMON_WORDS, *NOT_NAMES))
    once = word.groupBy("photo_id", "key").agg(F.min(F.struct("at", "word")).alias("w"))
    once = once.repartitionByRange("photo_id").sortWithinPartitions("photo_id", "w.at")  # a photo's words have numbers one after another
    once = materialise(once.select("photo_id", "key", F.col("w.word").alias("word"), F.monotonically_increasing_id().alias("o")), "photo-words")
    keys = materialise(once.select("key").distinct().withColumn("k", F.monotonically_increasing_id()), "photo-word-keys")  # numbers are counted, not strings
    each = F.struct("o", (F.col("k") * 2 + F.col("word").rlike(r"^\p{Lu}").cast("int")).alias("word"))
    held = once.join(keys, "key").groupBy("photo_id").agg(F.min("o").alias("o"), F.count("*").alias("w"), F.transform(F.sort_array(F.collect_list(each)), lambda x: x["word"]).alias("words"))
    held = materialise(held, "words-by-photo")
    known = photos.select(F.col("id").alias("photo_id"), F.substring("taken_at", 1, 7).alias("month"))
    shown = auto.select(F.col("id").alias("photo_id"), "album").groupBy("photo_id").agg(F.collect_set("album").alias("shown"))
    own = chosen.join(known, "photo_id").join(held.select("photo_id", "o", "w"), "photo_id", "left").join(shown, "photo_id", "left")
    own = materialise(own.select("album_id", "month", "o", "w", "shown").hint("rebalance", "album_id"), "album-photos-known")
    size = materialise(own.groupBy("album_id").agg(F.count("*").alias("n"), F.min("month").alias("m1"), F.max("month").alias("m2"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")), "album-sizes")
    top = _top_words(own.where("o is not null").select("album_id", "o"), size, held.select("o", "words"))
    shown = F.col("word")
    top = top.join(once.select("o", "word"), "o").select("album_id", "place", F.when((F.upper(shown) == shown) & (F.lower(shown) != shown), title(shown)).otherwise(shown).alias("name"))
    top = top.groupBy("album_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("words"))
    held = own.select("album_id", F.explode("shown").alias("album")).groupBy("album_id", "album").agg(F.count("*").alias("k"))
    held = held.groupBy("album_id").agg(F.max(F.struct("k", "album")).alias("h"))
    out = size.join(top, "album_id", "left").join(held, "album_id", "left")
    called = F.col("h.album")
    for key, name in (labels or {}).items():
        called = F.when(F.col("h.album") == key, name).otherwise(called)
    album = F.when((F.col("h.k") * 2 >= F.col("n")) & (F.col("h.album") != "people"), called)
    same_year = F.substring("m1", 1, 4) == F.substring("m2", 1, 4)
    date = F.when(F.col("m1") == F.col("m2"), F.date_format(F.try_to_date(F.concat("m1", F.lit("-01")), "yyyy-MM-dd"), "MMMM yyyy")).when(same_year, F.substring("m1", 1, 4))
    names = F.array_distinct(F.array_compact(F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(album, date))))
    return out.select("album_id", F.slice(names, 1, 4).alias("names"))


def _top_words(own: DataFrame, size: DataFrame, held: DataFrame) -> DataFrame:
    """album_id, place (1, 2), o (of the word to show). own: album_id and the photo's number o; size: album_id, n, w; held: o and words of each photo.

    Selections are dealt to tasks with the words of the photos that they hold, each photo once a task. A task gives the two
    best words of a selection that it has whole; a large one is dealt in parts, whose counts are added up.
    """
    parts = F.greatest(F.ceil(F.col("n") / PHOTOS_A_TASK), F.ceil(F.col("w") / WORDS_A_TASK))
    large = size.select("album_id", parts.alias("parts")).where("parts > 1")  # as few as the tasks
    tasks = -(-(size.agg(F.sum("w")).first()[0] or 0) // WORDS_A_TASK) or 1
    spread = own.join(F.broadcast(large), "album_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    spread = spread.withColumn("g", F.pmod(F.xxhash64("album_id", F.pmod(F.xxhash64("o"), F.col("parts"))), F.lit(tasks)).cast("int"))
    dealt = materialise(spread.select("g", "album_id", (F.col("parts") == 1).alias("whole"), "o"), "album-words-dealt")
    words = dealt.select("g", "o").distinct().join(held, "o").select(F.col("g").alias("task"), F.col("o").alias("photo"), "words")
    count = dealt.groupBy("g").cogroup(words.groupBy("task")).applyInArrow(count_words, f"album_id {dict(own.dtypes)['album_id']}, k long, photos long, first long, big long, late long")
    count = count.groupBy("album_id", "k").agg(F.sum("photos").alias("photos"), F.min("first").alias("first"), F.min("big").alias("big"), F.max("late").alias("late"))
    count = count.join(size.select("album_id", "n"), "album_id").where(F.col("photos") >= F.when(F.col("n") > 1, 2).otherwise(1))
    place = F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("photos"), "first"))
    return count.withColumn("place", place).where("place <= 2").select("album_id", "place", F.coalesce("big", "late").alias("o"))


def count_words(rows: pa.Table, words: pa.Table) -> pa.Table:
    """album_id, word k, photos, and of its places the first, the first in capitals (null: none) and the last; the two best rows of a whole album, all of others.

    rows: album_id, whole, o (a photo). words: photo, words of each in the order of their places o, o + 1, ...; a word is 2 k, or 2 k + 1 if in capitals.
    """
    kind = rows.schema.field("album_id").type
    coded = rows.column("album_id").combine_chunks().dictionary_encode()
    lists = words.column("words").combine_chunks()
    value, offset = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    length = np.diff(offset, prepend=0)
    start, place = offset - length, words.column("photo").to_numpy()
    key, word = np.unique(value >> 1, return_inverse=True)
    by_place = np.argsort(place)
    album, o = coded.indices.to_numpy(), rows.column("o").to_numpy()
    order = np.lexsort((o, album))
    album, o, whole = album[order], o[order], rows.column("whole").to_numpy(zero_copy_only=False)[order]
    photo = by_place[np.searchsorted(place, o, sorter=by_place)]
    n = length[photo]
    opens = np.flatnonzero(np.diff(album, prepend=-1))  # first row of each album
    till, found, at = np.append(n.cumsum()[opens] - n[opens], n.sum()), [], 0
    while at < len(opens):
        to = max(at + 1, min(int(np.searchsorted(till, till[at] + STEP, "right")) - 1, at + (1 << 15)))
        lo, hi = opens[at], opens[to] if to < len(opens) else len(o)
        m = n[lo:hi]
        inside = np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
        source, where = np.repeat(start[photo[lo:hi]], m) + inside, np.repeat(o[lo:hi], m) + inside
        # rows are in the order of photo and place, so the number of a row tells which of two was first
        bits = int(len(source)).bit_length()
        packed = np.sort((np.repeat(album[lo:hi].astype(np.int64) - album[lo], m) * len(key) + word[source]) << bits | np.arange(len(source)))
        row, pair = packed & ((1 << bits) - 1), packed >> bits
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        photos, first = np.diff(np.append(cut, len(pair))), row[cut]
        of, none = pair[cut] // len(key), np.iinfo(np.int64).max
        big = np.minimum.reduceat(np.where(value[source[row]] & 1, where[row], none), cut)
        kept = ~whole[lo:hi][opens[at:to] - lo][of]
        score, each = photos << bits | (len(source) - first), np.flatnonzero(np.diff(of, prepend=-1))
        for _ in range(2):
            best = score == np.repeat(np.maximum.reduceat(score, each), np.diff(np.append(each, len(of))))
            kept |= best & (score >= 0)
            score = np.where(best, -1, score)
        late = where[row[np.append(cut[1:], len(pair)) - 1]]
        found.append([x[kept] for x in (of + album[lo], key[pair[cut] % len(key)], photos, where[first], big, late)])
        at = to
    made = [np.concatenate(x) for x in zip(*found, strict=True)]
    names = [coded.dictionary.take(pa.array(made[0])), *map(pa.array, made[1:4]), pa.array(made[4], mask=made[4] == np.iinfo(np.int64).max), pa.array(made[5])]
    return pa.Table.from_arrays(names, schema=pa.schema([("album_id", kind), *((c, pa.int64()) for c in ("k", "photos", "first", "big", "late"))]))
