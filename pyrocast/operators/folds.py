"""Folds whose state is what was accepted so far: thinning, rate limits, packing, compaction.

A fold runs inside one key, over its rows in order, as an expression in generated plans. Where a key
may be large, the state stays small: the last kept row, or the requests inside the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import haversine_km
from ..session import written


def thin(rows: DataFrame, keys: list[str], order: list[str], lat: str, lon: str, at: str, km: float, hours: float) -> DataFrame:
    """Rows kept greedily: the first, then each that is at least km and hours from the last one kept."""
    fields = list(dict.fromkeys([*order, at, lat, lon]))
    far = haversine_km(f"s[size(s) - 1].{lat}", f"s[size(s) - 1].{lon}", f"x.{lat}", f"x.{lon}")
    kind = ", ".join(f"{f}: {dict(rows.dtypes)[f]}" for f in fields)
    late = f"unix_timestamp(x.{at}) - unix_timestamp(s[size(s) - 1].{at}) >= {hours * 3600}"
    fold = f"aggregate(__rows, cast(array() AS array<struct<{kind}>>), (s, x) -> CASE WHEN size(s) = 0 OR ({late} AND {far} >= {km}) THEN concat(s, array(x)) ELSE s END)"
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__rows"))
    return grouped.select(*keys, F.explode(F.expr(fold)).alias("__r")).select(*keys, "__r.*")


def limit_rate(rows: DataFrame, key: str, at: str, tie: str, most: int, seconds: float) -> DataFrame:
    """key, at, tie, allowed, retry_after: at most `most` allowed requests in any window; rejected ones aren't recorded.

    A request exactly `seconds` old still counts. State: the times of allowed requests in the window.
    """
    now = f"unix_micros(CAST(x.{at} AS TIMESTAMP)) / 1e6"
    live = f"filter(s.times, t -> t >= {now} - {seconds})"
    empty = "named_struct('times', cast(array() AS array<double>), 'out', cast(array() AS array<struct<allowed: boolean, retry: double>>))"
    # the pruned list is bound by a one-step transform, so it is made once
    step = f"""element_at(transform(array({live}), l -> CASE
        WHEN size(l) >= {most} THEN named_struct('times', l, 'out', concat(s.out, array(named_struct('allowed', false, 'retry', CAST(l[0] + {seconds} - ({now}) AS DOUBLE)))))
        ELSE named_struct('times', concat(l, array(CAST({now} AS DOUBLE))), 'out', concat(s.out, array(named_struct('allowed', true, 'retry', 0D)))) END), 1)"""
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, tie))).alias("__rows"))
    done = grouped.withColumn("__out", F.expr(f"aggregate(__rows, {empty}, (s, x) -> {step}, s -> s.out)"))
    zipped = done.select(key, F.explode(F.arrays_zip("__rows", "__out")).alias("z"))
    return zipped.select(key, f"z.__rows.{at}", f"z.__rows.{tie}", F.col("z.__out.allowed").alias("allowed"), F.col("z.__out.retry").alias("retry_after"))


def limit_twice(rows: DataFrame, request_id: str, at: str, address: str, session: str, most: int, seconds: float) -> DataFrame:
    """id, rejected_by (null: allowed), retry_after: limit_rate by address, then by session among what the first allows.

    A request that the session's limit rejects has used the address' quota all the same; one without a session (null or empty)
    passes the second limit.
    """
    told = rows.select(F.col(request_id).alias("id"), F.col(at).alias("at"), F.coalesce(F.col(address).cast("string"), F.lit("")).alias("address"), F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"))
    first = limit_rate(told.filter("address <> ''"), "address", "at", "id", most, seconds).select("id", F.col("allowed").alias("a"), F.col("retry_after").alias("wait"))
    first = written(told.join(first, "id", "left").withColumns({"a": F.coalesce("a", F.lit(True)), "wait": F.coalesce("wait", F.lit(0.0))}))
    second = limit_rate(first.filter("a AND session <> ''").select("id", "at", "session"), "session", "at", "id", most, seconds).select("id", F.col("allowed").alias("b"), F.col("retry_after").alias("late"))
    both = first.join(second, "id", "left")
    rejected = F.when(~F.col("a"), "address").when(~F.coalesce("b", F.lit(True)), "session")
    return both.select("id", rejected.alias("rejected_by"), F.when(F.col("a"), F.coalesce("late", F.lit(0.0))).otherwise(F.col("wait")).alias("retry_after"))


def swept_sessions(rows: DataFrame, key: str, at: str, ttl: float = 4 * 3600, sweep: float = 600) -> DataFrame:
    """key, session (from 1), started, last_seen, requests: sessions end at the first sweep more than ttl seconds after their last request.

    Sweeps come at whole multiples of `sweep` seconds; a request before the sweep still finds its session.
    """
    t, every = F.unix_micros(F.col(at).cast("timestamp")), int(sweep * 1_000_000)
    w = Window.partitionBy("key").orderBy("t")
    told = rows.filter(F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), t.alias("t"))
    gone = F.floor(F.col("t") / every) > F.floor((F.lag("t").over(w) + int(ttl * 1_000_000)) / every)
    numbered = told.withColumn("__new", F.coalesce(gone, F.lit(True)).cast("long")).withColumn("session", F.sum("__new").over(w))
    return numbered.groupBy("key", "session").agg(F.timestamp_micros(F.min("t")).alias("started"), F.timestamp_micros(F.max("t")).alias("last_seen"), F.count("*").alias("requests"))


def accept_far(rows: DataFrame, order: str, lat: str, lon: str, at: str, km: float, days: int, degrees: float = 5.0) -> DataFrame:
    """Rows kept greedily: those without a kept row within km whose floor of days apart is below `days`.

    Tiles of so many degrees (wider than km) are dealt to four passes like the squares of a board, so that
    no two of a pass touch. A pass takes its tiles' rows in order, and knows what earlier passes kept in the
    tiles around. No two kept rows are near, and each row that isn't kept is near one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__kept", order], ascending=[False, True], kind="stable")
        la, lo = np.radians(pdf[lat].to_numpy(float)), np.radians(pdf[lon].to_numpy(float))
        t = pdf[at].to_numpy("datetime64[s]").astype(np.int64)
        known = int(pdf["__kept"].sum())
        kept, n = np.empty(len(pdf), np.int64), known
        kept[:known] = np.arange(known)
        for i in range(known, len(pdf)):
            k = kept[:n]
            a = np.sin((la[k] - la[i]) / 2) ** 2 + np.cos(la[i]) * np.cos(la[k]) * np.sin((lo[k] - lo[i]) / 2) ** 2
            near = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, a))) <= km
            if not (near & (np.abs((t[i] - t[k]) // 86400) < days)).any():
                kept[n], n = i, n + 1
        return pdf.iloc[kept[known:n]]

    tile = lambda c: F.floor(F.col(c) / degrees)
    fields = rows.columns
    rows = rows.filter(f"{lat} IS NOT NULL AND {lon} IS NOT NULL AND {at} IS NOT NULL").withColumns({"__y": tile(lat), "__x": tile(lon), "__kept": F.lit(False)})
    passes = F.pmod("__y", F.lit(2)) * 2 + F.pmod("__x", F.lit(2))
    accepted = None
    for i in range(4):
        mine = rows.filter(passes == i)
        if accepted is not None:
            around = accepted
            for c in ("__y", "__x"):
                around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
            mine = mine.unionByName(around.withColumn("__kept", F.lit(True)).filter(passes == i))
        now = written(mine.groupBy("__y", "__x").applyInPandas(run, mine.schema))
        accepted = now if accepted is None else accepted.unionByName(now)
    return accepted.select(*fields)


def pack(parts: str, most: int, joiner: str) -> Column:
    """The parts in a column, joined greedily into pieces of at most `most` characters; longer parts are cut."""
    cut = f"flatten(transform({parts}, p -> CASE WHEN length(p) <= {most} THEN array(p) ELSE transform(sequence(0, CAST((length(p) - 1) DIV {most} AS INT)), i -> substring(p, i * {most} + 1, {most})) END))"
    fits = f"size(s) > 0 AND length(s[size(s) - 1]) + {len(joiner)} + length(x) <= {most}"
    longer = f"concat(slice(s, 1, size(s) - 1), array(concat(s[size(s) - 1], '{joiner}', x)))"
    return F.expr(f"aggregate({cut}, cast(array() AS array<string>), (s, x) -> CASE WHEN x = '' THEN s WHEN {fits} THEN {longer} ELSE concat(s, array(x)) END)")


def semantic_blocks(text: str, most: int = 1800) -> Column:
    """The paragraphs of a text column (between blank lines, with single spaces) packed to blocks of at most `most` characters.

    A longer paragraph is cut at its sentences, which are packed with a line end between them; a sentence
    that is too long, or a paragraph of one, is cut where it is full. What comes of paragraphs is packed with an empty line between.
    """
    cut = lambda x: f"transform(sequence(0, (length({x}) - 1) DIV {most}), i -> substring({x}, CAST(i AS INT) * {most} + 1, {most}))"
    none = "named_struct('done', cast(array() AS array<string>), 'now', '')"
    flushed = "CASE WHEN s.now = '' THEN s.done ELSE concat(s.done, array(s.now)) END"

    def packed(parts: str, joiner: str, long: str) -> str:
        step = f"""CASE {long} WHEN s.now = '' THEN named_struct('done', s.done, 'now', x)
            WHEN length(s.now) + {len(joiner)} + length(x) <= {most} THEN named_struct('done', s.done, 'now', concat(s.now, '{joiner}', x))
            ELSE named_struct('done', concat(s.done, array(s.now)), 'now', x) END"""
        return f"aggregate({parts}, {none}, (s, x) -> {step}, s -> {flushed})"

    line, empty = "\n", "\n\n"
    sentences = "split(p, '(?<=[.!?])\\\\s+')"
    of_sentences = packed(sentences, line, f"WHEN length(x) > {most} THEN named_struct('done', concat({flushed}, {cut('x')}), 'now', '')")
    parts = f"CASE WHEN length(p) <= {most} THEN array(p) WHEN size({sentences}) > 1 THEN {of_sentences} ELSE {cut('p')} END"
    squeezed = f"filter(transform(split(coalesce({text}, ''), '\\\\n\\\\s*\\\\n'), b -> trim(regexp_replace(b, '\\\\s+', ' '))), b -> b <> '')"
    return F.expr(packed(f"flatten(transform({squeezed}, p -> {parts}))", empty, ""))


def recent(messages: DataFrame, conversation: str, turn: str, most: int) -> DataFrame:
    """The last `most` messages of each conversation."""
    order = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    return messages.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def compaction(messages: DataFrame, conversation: str, turn: str, role: str, text: str, threshold: int = 16, keep: int = 12) -> DataFrame:
    """conversation, n_messages, summarized, kept, older: beyond the threshold all but the last `keep` are to be summarized.

    older: what is to be summarized, a line `role: text` for each message in order, empty if nothing is; the summary
    itself is a language model's. A conversation's older messages are one text by nature.
    """
    order = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    rows = messages.withColumns({"__n": F.row_number().over(order), "__all": F.count("*").over(Window.partitionBy(conversation))})
    old = (F.col("__all") > threshold) & (F.col("__n") > keep)
    line = F.struct(turn, F.concat_ws(": ", F.col(role), F.col(text)).alias("line"))
    out = rows.groupBy(conversation).agg(F.count("*").alias("n_messages"), F.count_if(old).alias("summarized"), F.sort_array(F.collect_list(F.when(old, line))).alias("__old"))
    return out.select(conversation, "n_messages", "summarized", (F.col("n_messages") - F.col("summarized")).alias("kept"), F.array_join("__old.line", "\n").alias("older"))
