"""Benchmark decontamination by templates: questions are found again though numbers, names and units were changed.

Numbers, capitalised words and units become typed placeholders. Windows of ``WINDOW`` tokens are hash-joined to those of
the benchmark by their words without names. Where windows of an item lie at one distance in a document, the slots behind
the placeholders must agree: one value of the item stands for one value of the document. Built-in functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.llm.common import staged, table

WINDOW = 8
LITERALS = 3  # words that a benchmark window must have besides placeholders
RUN = 4  # words of a run by which a window is found, where it has as many without a name
COVERAGE = 0.5  # share of an item's windows that makes a document contaminated
BROADCAST_ROWS = 1_000_000  # a benchmark of more windows is joined by a shuffle

# Units of measure and money, in lower case.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters
litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars cent cents euro euros pound pounds usd eur gbp percent degree degrees mph kmh w kw v a hz""".split()

_TOKEN = r"\p{L}+|[0-9]+(?:[.,][0-9]+)*"


def tokens(text: Column) -> Column:
    """Words and numbers of a whole text (null: none)."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_TOKEN), F.lit(0))


def placeholder(token: Column) -> Column:
    """<num>, <unit> or <name> for a token that may change from one asking to the next, else null."""
    first = F.substring(token, 1, 1)
    return (
        F.when(first.between("0", "9"), "<num>")
        .when(token.isin(*UNITS), "<unit>")
        .when(first != F.lower(first), "<name>")
    )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, words, windows (how many), at, size, exact of each distinct item; shorter items are one window.

    Windows with fewer than ``LITERALS`` words are left out, unless an item has no other (exact).
    """
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("words"))
        .where("size(words) > 0 and item_id is not null")
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"))
    )
    size = F.least(F.size("words"), F.lit(WINDOW))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - F.least(F.size("words"), F.lit(WINDOW)))).alias("at")
    cut = F.slice("words", F.col("at") + 1, F.col("size"))
    rich = F.size(F.filter(cut, lambda w: placeholder(w).isNull())) >= F.least(F.lit(LITERALS), F.col("size"))
    cuts = items.select("item_id", "words", size.alias("size"), at).select("*", rich.alias("rich"))
    most = cuts.groupBy("item_id").agg(F.sum(F.col("rich").cast("int")).alias("n_rich"), F.count("*").alias("n_all"))
    kept = cuts.join(most, "item_id").where("rich or n_rich = 0")
    windows = F.when(F.col("n_rich") > 0, F.col("n_rich")).otherwise(F.col("n_all")).alias("windows")
    exact = (F.col("n_rich") == 0).alias("exact")
    return kept.select("item_id", "words", windows, "at", "size", exact)


def folded(word: Column) -> Column:
    """<num>, <unit> or the word in lower case."""
    low = F.lower(word)
    return F.when(F.substring(low, 1, 1).between("0", "9"), "<num>").when(low.isin(*UNITS), "<unit>").otherwise(low)


def _free(word: Column, exact: Column) -> Column:
    """True for a name of an item, in whose place any word may stand; an exact item has none."""
    return ~exact & F.coalesce(placeholder(word) == "<name>", F.lit(False))


def _seeds(items: DataFrame) -> DataFrame:
    """(item_id, at, windows, shape, off, hash) by which a window is found: a run of RUN words without names, else the two
    such words, neighbours among them, with most literals and then nearest to each other, else the only one.

    The shape is the distance from the first to the last, negative for a run. The few windows of a benchmark are taken
    apart into rows, one for each run or pair, of which the best stays.
    """
    cut = F.slice("words", F.col("at") + 1, F.col("size"))
    word = (
        items.select("item_id", "at", "windows", "exact", F.posexplode(cut).alias("k", "word"))
        .where(~_free(F.col("word"), F.col("exact")))
        .select(
            "item_id", "at", "windows", "k", F.xxhash64(folded(F.col("word"))).alias("mark"),
            placeholder(F.col("word")).isNull().cast("int").alias("literal"),
        )
    )
    # At most WINDOW rows each.
    order = Window.partitionBy("item_id", "at").orderBy("k")
    ahead = [F.lead("mark", i).over(order) for i in range(1, RUN)]
    whole = F.lead("k", RUN - 1).over(order) == F.col("k") + RUN - 1
    literals = sum((F.lead("literal", i).over(order) for i in range(1, RUN)), F.col("literal"))
    gap = F.lead("k", 1).over(order) - F.col("k")
    shaped = word.select(
        "item_id", "at", "windows", "k", "mark", literals.alias("in_run"), whole.alias("run"), gap.alias("gap"),
        (F.col("literal") + F.lead("literal", 1).over(order)).alias("in_pair"), F.array("mark", *ahead).alias("marks"),
    )
    hashed = lambda shape, n: F.xxhash64(F.lit(shape) if isinstance(shape, int) else shape, *(F.get("marks", F.lit(i)) for i in range(n)))
    entry = lambda kind, rank, shape, n: F.struct(
        F.lit(kind).alias("kind"), (-rank).alias("rank"),
        (F.lit(0) if isinstance(shape, int) else shape).alias("near"), F.col("k").alias("off"),
        (F.lit(shape) if isinstance(shape, int) else shape).cast("int").alias("shape"), hashed(shape, n).alias("hash"),
    )
    choice = (
        F.when(F.col("run"), entry(0, F.col("in_run"), -RUN, RUN))
        .when(F.col("gap").isNotNull(), entry(1, F.col("in_pair"), F.col("gap"), 2))
        .otherwise(entry(2, F.lit(0), 0, 1))
    )
    best = shaped.groupBy("item_id", "at", "windows").agg(F.min(choice).alias("seed"))
    return best.select("item_id", "at", "windows", "seed.shape", "seed.off", "seed.hash")


def _place_hashes(marks: Column, shapes: list[int]) -> Column:
    """For each place of an array of token hashes, those of all shapes that start there."""

    def one(i: Column, shape: int) -> Column:
        offsets = range(-shape) if shape < 0 else ((0, shape) if shape else (0,))
        return F.xxhash64(F.lit(shape), *(F.get(marks, i + k) for k in offsets))

    hashed = F.transform(F.sequence(F.lit(0), F.size(marks) - 1), lambda i: F.array(*(one(i, s) for s in shapes)))
    return F.when(F.size(marks) > 0, hashed).otherwise(F.array().cast("array<array<bigint>>"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold ``coverage`` of the windows of a benchmark item or more, whatever its parameters and its case.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. One row per pair: doc_id, item_id (of equal
    items the least), windows (of the item), matched, changed (slots whose value is not the item's). A window matches where
    its literals are the same in any case, numbers meet numbers, units units, and any word stands in the place of a name of
    the item, as a document's capitals tell nothing. Windows of an item without literals match its own words in any case
    alone. Of the windows at one distance, those go whose slots contradict the value that is most frequent for the item's
    slot (of ties the item's own, then the least). Null ids and null or empty texts match nothing; rows with one doc_id
    count as one document; either table may be empty.

    Rows stay small whatever the length of a document and however often it repeats an item: a hit is four numbers, and
    only the words under the windows of pairs that can reach the share are looked up, one by one.
    """
    items = staged(benchmark_windows(benchmark), "benchmark")
    seeds = _seeds(items).withColumn("seed_at", F.col("at") + F.col("off"))
    known = staged(seeds.select("hash", "shape", "item_id", "at", "seed_at", "windows"), "seeds")
    n, shapes = known.agg(F.count("*"), F.collect_set("shape")).first()  # at most WINDOW + 1 shapes
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    # Rows with one doc_id are told apart by their texts until the end.
    body = F.xxhash64(F.col("text").cast("string")).alias("body")
    named = docs.where("doc_id is not null").select(doc_id, body, tokens(F.col("text")).alias("words"))
    marked = named.select("doc_id", "body", F.transform("words", lambda w: F.xxhash64(folded(w))).alias("marks"))
    placed = marked.select("doc_id", "body", F.posexplode(_place_hashes(F.col("marks"), sorted(shapes) or [0])).alias("place", "hashes"))
    found = placed.select("doc_id", "body", "place", F.explode("hashes").alias("hash"))
    known = known.drop("shape")
    hits = found.join(F.broadcast(known) if n <= BROADCAST_ROWS else known, "hash").select(
        "doc_id", "body", "item_id", "windows", "at", (F.col("place") - F.col("seed_at")).cast("int").alias("shift")
    )
    hits = staged(hits.where(F.col("shift") + F.col("at") >= 0), "hits")
    # A window that matches has its seed there, so pairs with too few seeds go before words come in.
    per_pair = hits.select("doc_id", "item_id", "windows", "at").distinct().groupBy("doc_id", "item_id", "windows").count()
    likely = per_pair.where(F.col("count") >= F.lit(coverage) * F.col("windows")).select("doc_id", "item_id")
    likely = staged(likely, "likely")
    windows = hits.distinct().join(likely, ["doc_id", "item_id"], "left_semi")
    # The words of items and of likely documents, one row each.
    whole = items.groupBy("item_id").agg(F.first("words").alias("words"), F.first("size").alias("size"), F.first("exact").alias("exact"))
    item_words = whole.select("item_id", "size", "exact", F.posexplode("words").alias("slot", "word"))
    sizes = whole.select("item_id", "size")
    under = windows.join(sizes, "item_id").select(
        "doc_id", "body", "item_id", "windows", "shift", "at", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("slot")
    )
    doc_words = named.join(likely.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "body", F.posexplode("words").alias("place", "there")
    )
    met = (
        under.join(item_words.drop("size"), ["item_id", "slot"])
        .withColumn("place", F.col("shift") + F.col("slot"))
        .join(doc_words.distinct(), ["doc_id", "body", "place"], "left")
    )
    alike = F.when(F.col("exact"), F.lower("word") == F.lower("there")).otherwise(folded(F.col("word")) == folded(F.col("there")))
    same = F.col("there").isNotNull() & (_free(F.col("word"), F.col("exact")) | alike)
    is_slot = placeholder(F.col("word")).isNotNull()
    key = ["doc_id", "body", "item_id", "shift"]
    lettered = met.select(
        *key, "windows", "at", "slot", F.when(is_slot, F.col("word")).alias("item"), F.lower("there").alias("doc"),
        F.coalesce(same, F.lit(False)).alias("same"),
    )
    per_window = lettered.groupBy(*key, "windows", "at").agg(
        F.collect_set(F.when(F.col("same"), F.col("slot"))).alias("fits"),
        F.count_distinct("slot").alias("n"),
        # At most WINDOW slots, and a document's word for each.
        F.collect_set(F.when(F.col("same") & F.col("item").isNotNull(), F.struct("slot", "item", "doc"))).alias("slots"),
    )
    aligned = staged(per_window.where(F.size("fits") == F.col("n")).drop("fits", "n"), "aligned")
    slots = aligned.select(*key, F.explode("slots").alias("s")).select(*key, "s.*").distinct()
    own = (F.col("doc") == F.lower("item")).alias("own")
    values = slots.groupBy(*key, "item", "doc").agg(F.count("*").alias("times")).select("*", own)
    rank = F.struct((-F.col("times")).alias("n"), (~F.col("own")).alias("o"), "doc")
    best = values.groupBy(*key, "item").agg(F.min(rank)["doc"].alias("best"))
    torn = slots.join(best, [*key, "item"]).where((F.col("doc") != F.col("best")) & (F.col("doc") != F.lower("item")))
    bad = torn.groupBy(*key, "slot").agg(F.lit(True).alias("torn"))
    kept = (
        aligned.select(*key, "windows", "at", F.explode_outer("slots").alias("s"))
        .select(*key, "windows", "at", "s.*")
        .join(bad, [*key, "slot"], "left")
        .withColumn("clear", F.max(F.coalesce("torn", F.lit(False))).over(Window.partitionBy(*key, "at")) == F.lit(False))
        .where("clear")
    )
    changed = F.when(F.col("doc") != F.lower("item"), F.struct("item", "doc"))
    per_shift = kept.groupBy(*key).agg(F.count_distinct(changed).alias("changed"))
    least = per_shift.groupBy("doc_id", "item_id").agg(F.min("changed").cast("long").alias("changed"))
    matched = kept.groupBy("doc_id", "item_id").agg(
        F.max("windows").cast("long").alias("windows"), F.count_distinct("at").cast("long").alias("matched")
    )
    return matched.where(F.col("matched") >= F.lit(coverage) * F.col("windows")).join(least, ["doc_id", "item_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_DUCK_PLACE = f"""CASE WHEN w[1] BETWEEN '0' AND '9' THEN '<num>' WHEN w IN ({_UNIT_LIST}) THEN '<unit>'
    WHEN w[1] <> lower(w[1]) THEN '<name>' END"""
_DUCK_FOLD = f"""CASE WHEN lower(w)[1] BETWEEN '0' AND '9' THEN '<num>' WHEN lower(w) IN ({_UNIT_LIST}) THEN '<unit>'
    ELSE lower(w) END"""
OP10_SQL = f"""
WITH item_words AS (
  SELECT min(item_id)::BIGINT AS item_id, words
  FROM (SELECT item_id, regexp_extract_all(text, '\\p{{L}}+|[0-9]+(?:[.,][0-9]+)*') AS words FROM benchmark)
  WHERE len(words) > 0 GROUP BY words
), cuts AS (
  SELECT item_id, unnest(range(greatest(len(words) - {WINDOW}, 0) + 1)) AS item_at, least(len(words), {WINDOW}) AS size, words
  FROM item_words
), item_cuts AS (
  SELECT item_id, item_at, size, words[item_at + 1 : item_at + size] AS cut FROM cuts
), judged AS (
  SELECT *, len([w for w in cut if ({_DUCK_PLACE}) IS NULL]) >= least({LITERALS}, size) AS rich FROM item_cuts
), counted AS (
  SELECT *, sum(rich::INT) OVER (PARTITION BY item_id) AS n_rich, count(*) OVER (PARTITION BY item_id) AS n_all FROM judged
), kept AS (
  SELECT item_id, item_at, size, cut, n_rich = 0 AS exact, CASE WHEN n_rich > 0 THEN n_rich ELSE n_all END AS windows,
    [CASE WHEN n_rich > 0 AND coalesce(({_DUCK_PLACE}) = '<name>', FALSE) THEN NULL ELSE ({_DUCK_FOLD}) END for w in cut] AS fixed
  FROM counted WHERE rich OR n_rich = 0
), keyed AS (
  SELECT *, [i for i in range(size) if fixed[i + 1] IS NOT NULL] AS spots FROM kept
), known AS (
  SELECT *, spots[1] AS off, coalesce(spots[2], spots[1]) - spots[1] AS gap, fixed[spots[1] + 1] AS one,
    fixed[coalesce(spots[2], spots[1]) + 1] AS two
  FROM keyed
), doc_words AS (
  SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|[0-9]+(?:[.,][0-9]+)*') AS words FROM documents WHERE doc_id IS NOT NULL
), doc_marks AS (
  SELECT doc_id, words, [({_DUCK_FOLD}) for w in words] AS marks FROM doc_words
), spaced AS (
  SELECT doc_id, gap, place, marks[place + 1] AS one, marks[place + 1 + gap] AS two
  FROM (SELECT doc_id, marks, gap, unnest(range(len(marks) - gap)) AS place
        FROM doc_marks, (SELECT DISTINCT gap FROM known) WHERE len(marks) > gap)
), hits AS (
  SELECT DISTINCT doc_id, item_id, windows, item_at, size, exact, cut, fixed, place - off AS start
  FROM spaced JOIN known USING (gap, one, two) WHERE place >= off
), faced AS (
  SELECT h.*, start - item_at AS shift, words[start + 1 : start + size] AS doc_cut, marks[start + 1 : start + size] AS doc_fixed
  FROM hits h JOIN doc_marks USING (doc_id) WHERE start + size <= len(words)
), aligned AS (
  SELECT * FROM faced
  WHERE len([i for i in range(size) if coalesce(fixed[i + 1] = doc_fixed[i + 1], TRUE)]) = size
    AND (NOT exact OR [lower(w) for w in cut] = [lower(w) for w in doc_cut])
), slots AS (
  SELECT DISTINCT doc_id, item_id, shift, item_at + i AS slot, cut[i + 1] AS w, lower(doc_cut[i + 1]) AS d
  FROM (SELECT *, unnest(range(size)) AS i FROM aligned)
), placed AS (
  SELECT * FROM slots WHERE ({_DUCK_PLACE}) IS NOT NULL
), ranked AS (
  SELECT doc_id, item_id, shift, w, arg_min(d, row(-n, d <> lower(w), d)) AS best
  FROM (SELECT doc_id, item_id, shift, w, d, count(*) AS n FROM placed GROUP BY ALL) GROUP BY doc_id, item_id, shift, w
), torn AS (
  SELECT DISTINCT doc_id, item_id, shift, slot FROM placed JOIN ranked USING (doc_id, item_id, shift, w)
  WHERE d <> best AND d <> lower(w)
), clear AS (
  SELECT DISTINCT doc_id, item_id, windows, shift, item_at, size FROM aligned a WHERE NOT EXISTS (
    SELECT 1 FROM torn t WHERE t.doc_id = a.doc_id AND t.item_id = a.item_id AND t.shift = a.shift
      AND t.slot >= a.item_at AND t.slot < a.item_at + a.size)
), changes AS (
  SELECT c.doc_id, c.item_id, c.shift, count(DISTINCT CASE WHEN d <> lower(w) THEN row(w, d) END) AS changed
  FROM clear c LEFT JOIN placed p ON c.doc_id = p.doc_id AND c.item_id = p.item_id AND c.shift = p.shift
    AND p.slot >= c.item_at AND p.slot < c.item_at + c.size
  GROUP BY ALL
)
SELECT doc_id, item_id, max(windows)::BIGINT AS windows, count(DISTINCT item_at)::BIGINT AS matched, min(changed)::BIGINT AS changed
FROM clear JOIN changes USING (doc_id, item_id, shift)
GROUP BY doc_id, item_id HAVING count(DISTINCT item_at) >= {COVERAGE} * max(windows)
"""
