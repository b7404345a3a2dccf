"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, queued again up to ``max_epochs``
times. A document's virtual finish time is the number of words its source has served up to its end
divided by the source's target. All queued documents are sorted by virtual finish time, across
sources, words are summed up in that order, and the mix ends where the sum reaches the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.common import fill, materialize, word_count

MAX_EPOCHS = 3
#: Running sums go slot by slot; slots hold about so many rows each, and there are at most so many slots.
SLOT_DOCS, MOST_SLOTS = 500, 1 << 17


def source_targets(stats: DataFrame, max_epochs: int = MAX_EPOCHS, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets per source from a table ``source, source_size`` of one row a source.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ...; the targets share the sum of
    all sizes by weight, none above ``max_epochs`` times its source's size, and what is cut off is
    shared among the others by weight until none is above. Only sums come to the driver.
    """
    # One row a source: ranked in key order. Spark compares strings by their UTF-8 bytes, which is the
    # order of code points.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("_nth", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("_nth") % len(cycle) + 1).cast("int"))
    )
    ranked = materialize(ranked.drop("_nth"), "mix-sources")
    most = F.col("source_size") * F.lit(float(max_epochs))
    total, level, above = float(ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > most if above >= 0 else F.lit(False)
        r = ranked.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if r["n"] == above or not r["open"]:
            break
        above, level = r["n"], (total - r["capped"]) / r["open"]
    return ranked.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def _running(rows: DataFrame, by: list[str], position: Column, order: list[Column], n: int) -> DataFrame:
    """``rows`` with ``_before``: the sum of ``size`` over the rows before each, within equal ``by``.

    ``position`` (0 up to 1, not falling along ``order``) deals the rows to slots; a task sums one slot, and the
    slots' sums, of which there are MOST_SLOTS at most, are added up in turn.
    """
    slots = max(64, min(MOST_SLOTS, -(-n // SLOT_DOCS)))
    rows = rows.withColumn("_slot", F.least(F.floor(position * slots), F.lit(slots - 1)).cast("int"))
    sums = rows.groupBy(*by, "_slot").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slot").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_sum"))
    within = Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("_slot") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = placed.join(sums, same).withColumn("_before", F.col("_sum") + F.col("_within"))
    return placed.select(*[c for c in rows.columns if c != "_slot"], "_before")


def schedule(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The mix as numbers: what it takes, in rows of documents and epochs, and one row per document.

    Returns ``(items, documents)``. ``documents``: doc_id, source, size, source_size, target, _start (words of
    its source before it in one epoch), _row and _nth (which row of the table it is: a hash of id, source and
    text, and a number among rows of the same hash). ``items``: the same with epoch, finish_time, and served, the
    number of its words that the mix takes; the document at which the budget is used up is cut there.

    Sizes count words; null text has none. Ties of the shuffle go by size; ties of finish times by source,
    place in the queue and epoch. Repeated rows are separate entries. An empty table gives empty
    results. Extra columns are ignored.
    """
    text_hash = F.xxhash64(fill(F.col("text")))
    sized = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_turn"),
        text_hash.alias("_text"), F.xxhash64("doc_id", F.col("source").cast("string"), text_hash).alias("_row"),
    )
    sized = materialize(sized, "mix-sizes")
    n = sized.count()
    stats = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-stats")
    budget = stats.agg(F.sum("source_size")).first()[0] or 0
    targets = source_targets(stats, max_epochs)
    lead = F.conv(F.substring("_turn", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = _running(sized, ["source"], lead, [F.col("_turn"), F.col("size"), F.col("_text")], n).withColumnRenamed("_before", "_start")
    # The targets have one row a source; left to the planner, which broadcasts them only while they are small.
    shares = targets.select(F.col("source").alias("_source"), "source_size", "target")
    numbered = Window.partitionBy("_row").orderBy("doc_id", "source", "size", "_text", "_start")
    documents = placed.join(shares, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_nth", F.row_number().over(numbered))
    documents = materialize(
        documents.select("doc_id", "source", "size", "source_size", "target", "_start", "_row", "_nth"), "mix-documents"
    )
    # Queued are all that start before their source's target. Their words reach the budget, as the targets do.
    epochs = F.ceil((F.col("target") - F.col("_start")) / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    queued = documents.where((F.col("size") > 0) & (F.col("_start") < F.col("target"))).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_epochs), F.greatest(epochs, F.lit(1))) - 1))
    )
    end = F.col("_start") + F.col("epoch") * F.col("source_size") + F.col("size")
    queued = queued.withColumn("finish_time", end / F.col("target"))
    order = [F.col("finish_time"), F.col("source").asc_nulls_first(), F.col("_start"), F.col("epoch")]
    items = _running(queued, [], F.least(F.col("finish_time"), F.lit(1.0)), order, n)
    taken = items.where(F.col("_before") < budget)
    return taken.withColumn("served", F.least(F.col("size"), F.lit(budget) - F.col("_before")).cast("long")).drop("_before"), documents


def mix(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: ``docs``' columns, a row for each time a document is taken, in order of virtual finish times.

    The document that the budget cuts keeps its leading words as they stand in the text, joined by a space.
    Documents without words are not taken. Rows of equal finish time are in no set order. Repeated rows are taken
    each on its own. Any columns besides doc_id, source and text pass through, whatever their names; n_chars, where
    there is one, follows the text. An empty table gives an empty mix.
    """
    items, _ = schedule(docs, seed, max_epochs)
    taken = items.groupBy("_row").agg(F.collect_list(F.struct("_nth", "served", "size", "finish_time")).alias("_items"))
    # The rows travel as one column, so that no name of theirs meets one of ours. Rows of equal hash are numbered
    # here as they were in the schedule, by what they hold, so each entry meets its own text.
    text = F.col("_doc.text")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).select(
        "_doc", F.xxhash64("_doc.doc_id", F.col("_doc.source").cast("string"), F.xxhash64(fill(text))).alias("_row"),
    )
    own = Window.partitionBy("_row").orderBy("_doc.doc_id", F.col("_doc.source").cast("string"), word_count(text), F.xxhash64(fill(text)))
    both = keyed.withColumn("_own", F.row_number().over(own)).join(taken, "_row")
    both = both.select("_doc", "_own", F.explode("_items").alias("_item")).where("_own = _item._nth")
    pieces = F.split(F.regexp_replace(fill(text), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_item.served").cast("int")), " ")
    whole = F.col("_item.served") >= F.col("_item.size")
    changed = {"text": cut, "n_chars": F.length(cut)}
    kept = [
        (F.when(whole, F.col(f"_doc.`{c}`")).otherwise(changed[c].cast(t)) if c in changed else F.col(f"_doc.`{c}`")).alias(c)
        for c, t in docs.dtypes
    ]
    ordered = both.select(F.struct(*kept).alias("_doc"), F.col("_item.finish_time").alias("_finish"))
    return ordered.repartitionByRange("_finish").sortWithinPartitions("_finish").select("_doc.*")


def taken_words(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``: the words of it in the mix, all epochs together."""
    items, documents = schedule(docs, seed, max_epochs)
    shown = ["doc_id", "size", "source_size", "target"]
    # Within a source, documents with words differ in where they start.
    queued = documents.where("size > 0").withColumn("served", F.lit(0).cast("long"))
    key = ["source", "_start", *shown]
    taken = queued.select(*key, "served").unionByName(items.select(*key, "served")).groupBy(*key).agg(F.sum("served").alias("taken"))
    blank = documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*shown, "taken").unionByName(blank.select(*shown, "taken"))
