"""Recogniser output: utterances, merging inputs, and the formats of a transcript."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxmill.functions.scalars import join_single_characters, srt_time, truthy

UTTERANCE = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"


def utterances(raw: Column) -> Column:
    """Timed utterances of a result document.

    Sentences (``stamp_sents``) come first, each with its time from ``ts``, else from
    ``start`` and ``end``, else from the ends of ``ts_list``; members without both
    times, and members that aren't objects, are left out. Without sentences, pairs in
    ``timestamp`` time the characters of ``text``; else the text stands at 0-0.
    """
    sents = F.from_json(F.get_json_object(raw, "$.stamp_sents"), "array<string>")
    number = lambda s, p: F.get_json_object(s, p).try_cast("double").cast("bigint")

    def one(s: Column) -> Column:
        ts, flat = (number(s, "$.ts[0]"), number(s, "$.ts[1]")), (number(s, "$.start"), number(s, "$.end"))
        spans = F.from_json(F.get_json_object(s, "$.ts_list"), "array<string>")
        listed = (number(F.get(spans, F.lit(0)), "$[0]"), number(F.get(spans, F.size(spans) - 1), "$[1]"))
        pick = lambda i: F.when(ts[0].isNotNull() & ts[1].isNotNull(), ts[i]).when(flat[0].isNotNull() & flat[1].isNotNull(), flat[i]).otherwise(listed[i])
        text = join_single_characters(F.coalesce(F.get_json_object(s, "$.text_seg"), F.lit("")), F.coalesce(F.get_json_object(s, "$.punc"), F.lit("")))
        return F.struct(pick(0).alias("start_ms"), pick(1).alias("end_ms"), text.alias("text"))

    timed = F.filter(F.transform(F.filter(sents, lambda s: s.startswith("{")), one), lambda u: u["start_ms"].isNotNull() & u["end_ms"].isNotNull())
    text = F.coalesce(F.get_json_object(raw, "$.text"), F.lit(""))
    pairs = F.from_json(F.get_json_object(raw, "$.timestamp"), "array<string>")
    by_character = F.filter(
        F.transform(pairs, lambda p, i: F.struct(number(p, "$[0]").alias("start_ms"), number(p, "$[1]").alias("end_ms"), F.substr(text, i + 1, F.lit(1)).alias("text"))),
        lambda u: u["start_ms"].isNotNull() & u["end_ms"].isNotNull(),
    )
    plain = F.when(text != "", F.array(F.struct(F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"), text.alias("text")))).otherwise(F.array().cast(UTTERANCE))
    return F.when(F.size(sents) > 0, timed).when((F.size(pairs) > 0) & (text != "") & (F.size(by_character) > 0), by_character).otherwise(plain)


def has_times(parsed: Column) -> Column:
    """Some utterance has a start or an end above 0."""
    return F.exists(parsed, lambda u: (u["start_ms"] > 0) | (u["end_ms"] > 0))


def to_srt(lines: Column) -> Column:
    """Numbered subtitle blocks of an array of utterances."""
    blocks = F.transform(lines, lambda u, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(u["start_ms"]), F.lit(" --> "), srt_time(u["end_ms"]), F.lit("\n"), u["text"], F.lit("\n")))
    return F.array_join(blocks, "\n")


def to_txt(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda u: u["text"]), "\n")


def to_json(lines: Column) -> Column:
    return F.to_json(F.struct(F.array_join(F.transform(lines, lambda u: u["text"]), "").alias("text"), lines.alias("segments")))


def message(raw: Column) -> Column:
    """Struct of mode, text (with its fallbacks), is_final, is_complete and the server's habit with the final flag."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    sents = F.from_json(get("stamp_sents"), "array<string>")
    joined = F.array_join(F.transform(F.filter(sents, lambda s: s.startswith("{")), lambda s: F.coalesce(F.get_json_object(s, "$.text_seg"), F.lit(""))), "")
    text = F.coalesce(*(F.nullif(c, F.lit("")) for c in (get("text"), joined, get("text_2pass_offline"), get("text_2pass_online"))), F.lit(""))
    mode, final = F.lower(F.coalesce(get("mode"), F.lit(""))), truthy(get("is_final"))
    done = final | (mode == "offline") | F.contains(mode, F.lit("2pass-offline")) | F.contains(mode, F.lit("2pass_offline")) | ((mode == "") & F.coalesce(F.size(sents) > 0, F.lit(False)))
    return F.struct(mode.alias("mode"), text.alias("text"), final.alias("is_final"), done.alias("is_complete"), F.when(mode == "offline", F.when(final, "legacy_true").otherwise("always_false")).alias("final_habit"))
