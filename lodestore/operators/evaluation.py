"""Evaluation analytics: accuracies, resumable runs, condition fingerprints, pivots and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(hit: Column) -> Column:
    """100 * mean, 0 without rows."""
    return F.coalesce(100.0 * F.avg(hit.cast("double")), F.lit(0.0))


def accuracy(rows: DataFrame, by: list[str], hit: str = "is_correct") -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.col(hit).cast("long")).alias("correct"), F.count("*").alias("total"), F.round(percent(F.col(hit)), 6).alias("accuracy"))


def todo(all_rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return all_rows.join(done.select(*key).distinct(), key, "left_anti")


def resumed(done: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Checkpoint and new results together; the new ones win."""
    return new.unionByName(done.join(new.select(*key), key, "left_anti"))


def fingerprints(rows: DataFrame, condition: str, parts: list[str]) -> DataFrame:
    """condition, fingerprint: conditions with the same rows have the same fingerprint.

    Row hashes are added up, so no condition is collected into one row.
    """
    h = [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]
    return rows.groupBy(condition).agg(F.concat_ws(":", F.count("*"), *[F.sum(x.cast("decimal(38,0)")) for x in h]).alias("fingerprint"))


def condition_groups(prints: DataFrame, condition: str) -> DataFrame:
    """fingerprint, leader (the first condition of a group), condition."""
    w = Window.partitionBy("fingerprint")
    return prints.withColumn("leader", F.min(condition).over(w))


def best_by(rows: DataFrame, by: list[str], value: str, order: str, positive: bool = True) -> DataFrame:
    """The row with the largest value of each group, the first of equals; only values above 0."""
    rows = rows.where(F.col(value) > 0) if positive else rows
    w = Window.partitionBy(*by).orderBy(F.desc(value), order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report_pivot(rows: DataFrame, by: list[str], column: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(*by).pivot(column, values).agg(F.first(value))


def markdown_report(cells: DataFrame, by: list[str], columns: list[str], title: str) -> DataFrame:
    """ord, line: a report as Markdown, one table row for each row of cells in the order of `by`; empty cells for nulls.

    cells is a report, small by nature: its rows are numbered in one window.
    """
    names = [*by, *columns]
    head = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    rows = cells.select((F.row_number().over(Window.orderBy(*by)) + len(head) - 1).alias("ord"), text.alias("line"))
    return cells.sparkSession.createDataFrame(list(enumerate(head)), "ord int, line string").unionByName(rows)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows: an equal quota of each stratum by hash order, then the next ones of all strata to fill up."""
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    quota = max(1, n // max(rows.select(stratum).distinct().count(), 1))
    w = Window.partitionBy(stratum).orderBy("_m", key)
    # no stratum gives more than n, so tasks pass on the first n of each before the strata meet
    marked = rows.withColumn("_m", mark).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return marked.orderBy((F.col("_r") > quota).cast("int"), "_m", key).limit(n).drop("_m", "_r")


def first_of_group(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def layout_accuracy(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """wanted(id, hash, strategy, width) with the accuracy expected from table(hash, acc).

    The configuration itself; else the mean of those that start with strategy_width times 0.9; else of those of
    the same width times 0.7; else 0.3.
    """
    names = "single_column|two_column|side_by_side|compact|emphasis|grid|text_wrap|panoramic"
    t = table.withColumn("s", F.regexp_extract("hash", f"^({names})_", 1)).withColumn("w", F.regexp_extract("hash", f"^(?:{names})_([a-z]+)", 1))
    near = t.groupBy(F.col("s").alias("strategy"), F.col("w").alias("width")).agg(F.avg("acc").alias("near"))
    # the width class anywhere inside the name, so an image scale of the same name counts too
    inside = F.filter(F.array(F.lit("narrow"), F.lit("medium"), F.lit("wide")), lambda c: F.contains("hash", F.concat(F.lit("_"), c, F.lit("_"))))
    wide = table.select("acc", F.explode(inside).alias("width")).groupBy("width").agg(F.avg("acc").alias("wide"))
    rows = wanted.join(table.select("hash", "acc"), "hash", "left").join(near, ["strategy", "width"], "left").join(wide, "width", "left")
    return rows.select("id", "hash", F.coalesce("acc", F.col("near") * 0.9, F.col("wide") * 0.7, F.lit(0.3)).alias("expected"))


def strategy_of(config: Column, strategies: tuple[str, ...]) -> Column:
    """The first strategy, in their order, that a configuration's name starts with; else what is before the first `_`."""
    known = F.coalesce(*[F.when(config.startswith(s), F.lit(s)) for s in strategies])
    return F.coalesce(known, F.substring_index(config, "_", 1))


def strategy_accuracy(results: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """strategy, total, correct, accuracy from results(pid, config_hash, correct)."""
    named = results.select(strategy_of(F.col("config_hash"), strategies).alias("strategy"), "correct")
    return named.groupBy("strategy").agg(F.count("*").alias("total"), F.sum(F.col("correct").cast("long")).alias("right"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select("strategy", "total", F.col("right").alias("correct"), "accuracy")


def reward_table(results: DataFrame, order: str = "ord") -> DataFrame:
    """pid, config_hash, accuracy (1 or 0): of a pair that was evaluated again the last result counts."""
    last = results.groupBy("pid", "config_hash").agg(F.max_by("correct", order).alias("correct"))
    return last.select("pid", "config_hash", F.col("correct").cast("double").alias("accuracy"))


def block_info(results: DataFrame, order: str = "ord") -> DataFrame:
    """pid, total_chars, has_image, n_blocks, has_knowledge: characters of the first result's question and choices;
    an image if any result names a figure or has a canvas; the last two are constants."""
    chars = F.length(F.coalesce("question", F.lit(""))) + F.aggregate(F.coalesce("choices", F.array().cast("array<string>")), F.lit(0), lambda s, c: s + F.length(c))
    pictured = F.contains("config_hash", F.lit("figure")) | (F.coalesce("canvas_w", F.lit(0)) > 0)
    found = results.groupBy("pid").agg(F.min_by(chars, order).cast("long").alias("total_chars"), F.bool_or(pictured).alias("has_image"))
    return found.select("*", F.lit(5).alias("n_blocks"), F.lit(True).alias("has_knowledge"))


def train_split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with `split`: train for the first int(share * n) in hash order, val for the others."""
    from lodestore.session import ranked_over_all

    cut = int(rows.count() * share)
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    ranked = ranked_over_all(rows, [mark, F.col(key)], "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("val")).drop("_rank")


def training_records(problems: DataFrame, rewards: DataFrame) -> DataFrame:
    """Nested rows data_source, prompt, ability, reward_model, extra_info for problems(pid, question, system, user,
    block_info) that have rewards(pid, config_hash, accuracy); the ground truth is JSON of the rewards and block_info."""
    tables = rewards.groupBy("pid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config_hash", "accuracy")))).alias("qa_table"))
    said = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    truth = F.to_json(F.struct("qa_table", "block_info"))
    return problems.join(tables, "pid").select(
        "pid",
        F.lit("layout_agent").alias("data_source"),
        F.array(said("system", "system"), said("user", "user")).alias("prompt"),
        F.lit("layout").alias("ability"),
        F.struct(truth.alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(F.col("pid").cast("string").alias("pid"), F.col("pid").alias("index"), "question").alias("extra_info"),
    )
