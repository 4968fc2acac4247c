"""Token economics, tokenizer calibration, and the project manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, get_counter
from ..sources.sinks import relative_path


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def savings(
    original: DataFrame, encoded: DataFrame, mapping_size: int = 0, counter: TokenCounter | None = None, chars_per_token: float | None = None, protocol_tokens: int = 0
) -> DataFrame:
    """One row of sizes before and after, gross and net. Tokens are counted, or taken as characters over a ratio."""
    counter = counter or get_counter()

    def sizes(docs: DataFrame, mark: str) -> DataFrame:
        tokens = F.lit(0) if chars_per_token else counter.column(F.col("text"))
        return docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias(f"{mark}_total"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias(f"{mark}_tokens_est"))

    row = sizes(original, "orig").crossJoin(sizes(encoded, "new"))  # one row each
    if chars_per_token:
        row = row.withColumns({f"{m}_tokens_est": F.bround(F.col(f"{m}_total") / chars_per_token).cast("long") for m in ("orig", "new")})
        mapping_tokens = F.bround(F.lit(mapping_size) / chars_per_token).cast("long")
    else:
        mapping_tokens = F.ceil(F.lit(mapping_size) / 4).cast("long")
    saved, net = F.col("orig_total") - F.col("new_total"), F.col("orig_total") - F.col("new_total") - mapping_size
    return row.select(
        "orig_total",
        "new_total",
        F.lit(mapping_size).cast("long").alias("mapping_size"),
        saved.alias("saved_chars"),
        _pct(saved, F.col("orig_total")).alias("saved_pct"),
        net.alias("net_saved_chars"),
        _pct(net, F.col("orig_total")).alias("net_saved_pct"),
        "orig_tokens_est",
        "new_tokens_est",
        mapping_tokens.alias("mapping_tokens_est"),
        F.lit(protocol_tokens).cast("long").alias("protocol_tokens"),
        (F.col("orig_tokens_est") - F.col("new_tokens_est") - mapping_tokens - protocol_tokens).alias("net_saved_tokens"),
    )


def stages(raw: DataFrame, canonical: DataFrame, encoded: DataFrame, mapping_tokens: int = 0, protocol_tokens: int = 0, counter: TokenCounter | None = None) -> DataFrame:
    """``stage, before_tokens, after_tokens, saved_tokens, saved_pct`` for canonical forms, encoding (gross and net), and all of it."""
    counter = counter or get_counter()

    def total(docs: DataFrame, name: str) -> DataFrame:
        return docs.agg(F.coalesce(F.sum(counter.column(F.col("text"))), F.lit(0)).cast("long").alias(name))

    row = total(raw, "raw").crossJoin(total(canonical, "canon")).crossJoin(total(encoded, "enc"))  # one row each
    extra = mapping_tokens + protocol_tokens
    steps = [("1-canonical", "raw", F.col("canon")), ("2-encoded-gross", "canon", F.col("enc")), ("2-encoded-net", "canon", F.col("enc") + extra), ("3-total-net", "raw", F.col("enc") + extra)]
    packed = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(b).alias("before_tokens"), a.cast("long").alias("after_tokens")) for n, b, a in steps])
    out = row.select(F.explode(packed).alias("s")).select("s.*")
    saved = F.col("before_tokens") - F.col("after_tokens")
    return out.withColumn("saved_tokens", saved).withColumn("saved_pct", _pct(saved, F.col("before_tokens")))


def calibration(samples: DataFrame, real: Column, heuristic: Column, empty_ratio: float = 1.0, empty_error: float = 0.0) -> DataFrame:
    """One row that holds a heuristic count against a real one: errors in percent, ratio, and the mean difference with its 95 % interval.

    ``empty_ratio`` and ``empty_error`` are those of samples without real tokens; samples whose real count is null have neither.
    """
    diff, ratio = F.col("h") - F.col("r"), F.when(F.col("r") > 0, F.col("h") / F.col("r")).when(F.col("r") <= 0, F.lit(empty_ratio))
    error = F.when(F.col("r") > 0, F.abs(diff) * 100.0 / F.col("r")).when(F.col("r") <= 0, F.lit(empty_error))
    row = samples.select(real.cast("long").alias("r"), heuristic.cast("long").alias("h")).agg(
        F.count("*").alias("samples"),
        F.sum("r").alias("total_real_tokens"),
        F.sum("h").alias("total_heuristic_tokens"),
        F.avg(error).alias("e"),
        F.avg(ratio).alias("q"),
        F.avg(diff).alias("d"),
        F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("s"),
    )
    margin = 1.96 * F.col("s") / F.sqrt("samples")
    return row.select(
        "samples",
        "total_real_tokens",
        "total_heuristic_tokens",
        F.when(F.col("total_real_tokens") > 0, F.bround(F.abs(F.col("total_heuristic_tokens") - F.col("total_real_tokens")) * 100.0 / F.col("total_real_tokens"), 2)).otherwise(0.0).alias("aggregate_error_pct"),
        F.bround("e", 2).alias("mean_sample_error_pct"),
        F.bround("q", 4).alias("mean_ratio"),
        F.bround("d", 2).alias("mean_diff_tokens"),
        F.bround(F.col("d") - margin, 3).alias("ci_low"),
        F.bround(F.col("d") + margin, 3).alias("ci_high"),
    )


def token_ratio(samples: DataFrame, real: Column, heuristic: Column) -> DataFrame:
    """``ratio`` of the two counts for every row, to four places."""
    return samples.withColumn("ratio", F.when(real > 0, F.bround(heuristic / real, 4)).otherwise(F.lit(1.0)))


def manifest(files: DataFrame, used: DataFrame, root: str | None) -> DataFrame:
    """``i, path, sha, ph``: files in order of path, each with the tokens it uses. ``files`` has ``path, file_ord, sha256``, ``used`` the places of tokens.

    Other columns of ``files`` follow.
    """
    tokens = used.select("token", "path").distinct().groupBy("path").agg(F.sort_array(F.collect_list("token")).alias("ph"))
    return files.join(tokens, "path", "left").select(
        F.col("file_ord").alias("i"), relative_path(F.col("path"), root).alias("path"), F.col("sha256").alias("sha"), F.coalesce("ph", F.array().cast("array<string>")).alias("ph"),
        *[files[c] for c in files.columns if c not in ("path", "file_ord", "sha256")],
    )


def manifest_document(rows: DataFrame, book: DataFrame) -> dict:
    """The manifest as one JSON value, for a project whose files a driver can list."""
    listed = sorted(rows.collect(), key=lambda r: r["i"])
    return {
        "paths": [r["path"] for r in listed],
        "files": [{"i": r["i"], "sha": r["sha"], "ph": r["ph"]} for r in listed],
        "ph": {r["token"]: {"sha": r["sha256"], "len": r["length"]} for r in book.select("token", "sha256", "length").collect()},
        "v": 1,
    }
