"""Scalar functions: columns in, a column out, nothing but built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from voxmill import constants as C
from voxmill.operators.filters import extension


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours may need more than two digits."""
    return F.format_string("%02d:%02d:%02d,%03d", _div(ms, 3_600_000), _div(ms, 60_000) % 60, _div(ms, 1000) % 60, ms % 1000)


def join_single_characters(text: Column, punctuation: Column) -> Column:
    """Spaces go only where every token is one character; then the punctuation is appended."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    single = F.contains(text, F.lit(" ")) & (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.length(t) == 1)
    return F.concat(F.when(single, F.array_join(tokens, "")).otherwise(text), punctuation)


def _by_state(status: Column, values: dict, which: int) -> Column:
    return reduce(lambda c, kv: c.when(status == kv[0], F.lit(kv[1][which])), values.items(), F)


def progress(status: Column, started_s: Column, duration: Column, rtf: float | Column, as_of: int) -> Column:
    """Low end of the state's band; running work moves through it with elapsed time."""
    low, high = _by_state(status, C.PROGRESS_BANDS, 0), _by_state(status, C.PROGRESS_BANDS, 1)
    total = duration * rtf
    share = F.least(F.lit(1.0), (F.lit(as_of) - started_s) / total)
    moving = (status == "TRANSCRIBING") & started_s.isNotNull() & (duration > 0) & (total > 0)
    return F.coalesce(F.when(moving, F.least(high, low + share * (high - low))).otherwise(low), F.lit(0.0))


def eta(status: Column, started_s: Column, duration: Column, rtf: float, as_of: int) -> Column:
    """Seconds left: 0 when ended, what remains when running, else the whole and 5; null when the duration is unknown."""
    known = F.coalesce(duration, F.lit(0)) != 0
    return F.when(status.isin(*C.TERMINAL), 0).when((status == "TRANSCRIBING") & started_s.isNotNull() & known, F.greatest(F.lit(0), duration * rtf - (F.lit(as_of) - started_s)).cast("int")).when(known, (duration * rtf + 5).cast("int"))


def eta_split(status: Column, estimate: Column) -> tuple[Column, Column, Column]:
    """(queue, running, display) estimates by state."""
    queue, running = F.when(status.isin(*C.QUEUE), estimate), F.when(status.isin(*C.ACTIVE_SLOT), estimate)
    return queue, running, F.coalesce(running, queue, F.lit(0))


def progress_text(status: Column, share: Column, position: Column) -> Column:
    plain = reduce(lambda c, kv: c.when(status == kv[0], F.lit(kv[1])), C.PROGRESS_TEXT.items(), F).otherwise("未知状态")
    return F.when((status == "QUEUED") & (position > 0), F.format_string("排队中（第%d位）", position.cast("int"))).when(status == "TRANSCRIBING", F.format_string("转写中（%d%%）", F.bround(share * 100, 0).cast("int"))).otherwise(plain)


def processing_time(duration: Column, rtf: Column, running: Column, is_segment: Column, factor: Column, penalty: float = 0.1) -> Column:
    return (duration * rtf * (1 + penalty * running) + F.when(is_segment, 8.0).otherwise(5.0)) * factor


def queue_eta(position: Column, mean_s: Column, slots: Column, running: Column, asr_s: Column, overhead: float = 5.0) -> Column:
    free = F.greatest(slots - running, F.lit(1))
    waiting = F.when(position > 0, position * mean_s / free).otherwise(0.0)
    return F.greatest((waiting + asr_s + overhead).cast("int"), F.lit(1))


def work_timeout(duration: Column) -> Column:
    return F.least(F.lit(3600.0), F.greatest(F.lit(120.0), duration * 2.0))


def backoff(retries: Column, base: float = 1.0, most: float = 60.0, jitter: float = 0.1) -> tuple[Column, Column, Column]:
    """(delay without jitter, its lowest, its highest value)."""
    raw = F.least(F.lit(base) * F.pow(F.lit(2.0), retries), F.lit(most))
    return raw, F.greatest(F.lit(0.1), raw * (1 - jitter)), raw * (1 + jitter)


def safe_name(name: Column) -> Column:
    """Last path part without leading dots; nothing left: unnamed."""
    base = F.regexp_replace(F.regexp_extract(F.regexp_replace(name, "/+$", ""), r"[^/]*$", 0), r"^\.+", "")
    return F.when(base == "", "unnamed").otherwise(base)


def stem(name: Column) -> Column:
    return F.regexp_replace(safe_name(name), r"(?<=.)\.[^.]+$", "")


def sharded_path(root: str, key: Column, name: Column, prefix: int = 4) -> Column:
    return F.concat_ws("/", F.lit(root), F.substring(key, 1, prefix), key, name)


def duration_estimate(name: Column, size: Column) -> Column:
    """Seconds from the size by the extension's byte rate; unknown extension or empty file: null."""
    ext = extension(name)
    rate = reduce(lambda c, kv: c.when(ext == kv[0], F.lit(kv[1])), C.BYTE_RATES.items(), F)
    return F.when(size > 0, size / rate)


def human_size(size: Column, decimals: int = 2, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    out = F.when(size < 1024, F.format_string("%d B", size.cast("long")))
    for i, unit in enumerate(units[1:], 1):
        text = F.format_string(f"%.{decimals}f {unit}", size / float(1024**i))
        out = out.otherwise(text) if unit == units[-1] else out.when(size < 1024 ** (i + 1), text)
    return out


def human_duration(seconds: Column) -> Column:
    h, m, s = _div(seconds, 3600), _div(seconds, 60) % 60, (seconds % 60).cast("long")
    return F.concat(F.when(h > 0, F.format_string("%dh ", h)).otherwise(""), F.when((h > 0) | (m > 0), F.format_string("%dm ", m)).otherwise(""), F.format_string("%ds", s))


def uptime(seconds: Column) -> Column:
    d, h, m = _div(seconds, 86400), _div(seconds, 3600) % 24, _div(seconds, 60) % 60
    return F.concat(F.when(d > 0, F.format_string("%d天", d)).otherwise(""), F.when(h > 0, F.format_string("%d时", h)).otherwise(""), F.format_string("%d分", m))


def batch_fingerprint(lines: Column, level: Column) -> Column:
    """First 32 hex digits of the sha256 of a batch's sorted ``name:size:language:options`` lines and its level."""
    return F.left(F.sha2(F.concat(F.array_join(F.array_sort(lines), "\n"), F.lit("\n"), level), 256), F.lit(32))


def canonical_json(options: Column) -> Column:
    """An options object with its keys in order; values as they are; unreadable: null."""
    entries = F.array_sort(F.map_entries(F.from_json(options, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def file_fingerprint(path: Column, size: Column, mtime: Column) -> Column:
    return F.concat_ws(":", path, size.cast("string"), mtime.cast("string"))


def preflight(name: Column, size: Column, duration: Column, rtf: Column) -> Column:
    """Struct of needs_conversion, conversion_s, processing_s, warnings and ready."""
    ext = extension(name)
    accepted, convert = ext.isin(*C.MEDIA_EXTENSIONS), ~ext.isin(".wav", ".pcm")
    seconds = F.coalesce(duration, duration_estimate(name, size), F.lit(0.0))
    conversion = F.when(convert, F.floor(size / (10 * 1024 * 1024))).otherwise(0).cast("long")
    warnings = F.array_compact(F.array(F.when(size == 0, "empty"), F.when(~accepted, "unsupported"), F.when(duration.isNull(), "imprecise"), F.when(seconds > 3600, "long"), F.when(size > 500 * 1024 * 1024, "large"), F.when(ext.isin(*C.VIDEO_EXTENSIONS), "video")))
    return F.struct(convert.alias("needs_conversion"), conversion.alias("conversion_s"), (F.floor(seconds * F.coalesce(rtf, F.lit(0.3))).cast("long") + conversion).alias("processing_s"), warnings.alias("warnings"), (accepted & (size > 0) & (size <= C.UPLOAD_CAP_BYTES)).alias("ready"))


def transcript_grade(text: Column, duration: Column) -> Column:
    """empty, garbled (over five special characters in a row), short for its duration, or ok."""
    body = F.trim(F.coalesce(text, F.lit("")))
    n = F.length(body)
    return F.when(n == 0, "empty").when(body.rlike(r"[^\p{L}\p{N}\s]{6,}"), "garbled").when(((duration > 60) & (n < 20)) | ((duration > 30) & (n < 10)), "short").otherwise("ok")


def keyword_baseline(text: Column, all_of: list[str], any_of: list[str], language: str) -> Column:
    """All of the words, any of the others, and a letter of the language."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = lambda ws: F.array(*(F.lit(w.lower()) for w in ws)).cast("array<string>")
    ok = F.forall(words(all_of), lambda w: F.contains(low, w)) & (F.lit(not any_of) | F.exists(words(any_of), lambda w: F.contains(low, w)))
    return ok & low.rlike(r"[一-鿿]" if language == "zh" else "[a-z]")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def edit_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """(edit distance, 1 - distance / longer length) without white space; two empty texts are equal."""
    x, y = squeezed(a), squeezed(b)
    d, n = F.levenshtein(x, y), F.greatest(F.length(x), F.length(y))
    return d, F.when(n == 0, 1.0).otherwise(1 - d / n)


def length_difference(a: Column, b: Column) -> Column:
    x, y = F.length(squeezed(a)), F.length(squeezed(b))
    return F.abs(x - y) / F.greatest(x, F.lit(1))


def difference_contexts(a: Column, b: Column, first: int = 10, around: int = 5) -> Column:
    """The first positions, counted from 0, at which the texts without spaces differ, each with what stands around it."""
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    pairs = F.arrays_zip(F.split(x, "").alias("x"), F.split(y, "").alias("y"))
    places = F.filter(F.transform(pairs, lambda p, i: F.when(p["x"] != p["y"], i)), lambda i: i.isNotNull())
    cut = lambda t, i: F.substr(t, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1)
    return F.transform(F.slice(places, 1, first), lambda i: F.concat_ws("|", i.cast("string"), cut(x, i), cut(y, i)))


def truncated(text: Column, n: int = 2000) -> Column:
    return F.left(text, F.lit(n))


def truthy(value: Column) -> Column:
    """A JSON value as a boolean: true, 1, yes, y and on in any case, and other numbers than 0."""
    v = F.lower(F.trim(value))
    return F.coalesce(v.isin("true", "1", "yes", "y", "on") | (F.coalesce(v.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


def recognition_options(options: Column) -> Column:
    """Struct of hotwords, mode (a known one) and the three switches (null: not given)."""
    get = lambda k: F.get_json_object(options, f"$.{k}")
    switch = lambda k: F.when(get(k).isNotNull(), truthy(get(k)))
    return F.struct(F.nullif(get("hotwords"), F.lit("")).alias("hotwords"), F.when(get("mode").isin("offline", "online", "2pass"), get("mode")).alias("mode"), switch("use_itn").alias("use_itn"), switch("use_punc").alias("use_punc"), switch("use_spk").alias("use_spk"))


def mode_list(offline: Column, two_pass: Column, online: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(offline, "offline"), F.when(two_pass, "2pass"), F.when(online, "online"))), ",")


def rtf(work_s: Column, audio_s: Column) -> tuple[Column, Column]:
    """(work for a second of audio, its inverse); null where there is nothing to divide by."""
    r = F.when(audio_s > 0, work_s / audio_s)
    return r, F.when(r > 0, 1 / r)
