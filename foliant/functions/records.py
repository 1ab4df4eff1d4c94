"""Column functions over records: fallbacks, checks of parsed output, keys, codes and parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant.functions import text as X


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor, as text, empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def compact(m: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def accepted_list(output: Column, original: Column) -> Column:
    """struct(items, error): ``output`` read as a JSON list of strings where it has one for each original, else the
    originals and what is wrong."""
    variant = F.try_parse_json(output)
    is_list = F.schema_of_variant(variant).startswith("ARRAY")
    items = F.from_json(F.when(is_list, output), "array<string>")
    kinds = F.transform(F.from_json(F.when(is_list, output), "array<variant>"), lambda v: F.schema_of_variant(v))
    error = (
        F.when(variant.isNull(), "not JSON")
        .when(~is_list, "not a list")
        .when(F.size(items) != F.size(original), "wrong length")
        .when(F.exists(kinds, lambda k: k != "STRING"), "not all strings")
    )
    return F.struct(F.when(error.isNull(), items).otherwise(original).alias("items"), error.alias("error"))


def zip_or_keep(new: Column, original: Column) -> Column:
    """The i-th new value for the i-th original; all originals where the numbers differ or a new value is null."""
    fits = (F.size(new) == F.size(original)) & ~F.exists(new, lambda v: v.isNull())
    return F.when(fits, new).otherwise(original)


def id_list(x: Column) -> Column:
    """Positive whole numbers of a JSON list, written as numbers or digits, each once and in order; null for other text."""
    items = F.from_json(x, "array<string>")
    numbers = F.filter(F.transform(items, lambda v: F.when(F.trim(v).rlike("^[0-9]+$"), F.trim(v).try_cast("long"))), lambda n: n > 0)
    return F.array_distinct(numbers)


def selection_or_null(chosen: Column, total: Column) -> Column:
    """The chosen list, null (no selection) where it has everything."""
    return F.when(F.size(chosen) < total, chosen)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A request as JSON with its names in order; nulls are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def cache_key(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def word_range(words: Column, a: Column, b: Column) -> Column:
    """Words from index ``a`` to ``b``, both included, in either order."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.slice(words, low + 1, high - low + 1)


def copies(place: Column, jobs: Column, capacity: int) -> Column:
    """How many of ``capacity`` equal slots the job at ``place`` (from 0) gets when fewer jobs than slots share them."""
    base, extra = F.floor(F.lit(capacity) / jobs), F.lit(capacity) % jobs
    return F.when(jobs < capacity, base + F.when(place < extra, 1).otherwise(0)).otherwise(1).cast("int")


def lang_code(lang: Column, voice: Column, aliases: dict[str, str], codes: list[str]) -> Column:
    """A language's code: by alias, else the voice's first letter, else the language itself; null where none is known."""
    norm = F.lower(F.translate(lang, "_", "-"))
    by_alias = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[norm]
    letter = F.left(F.lower(F.substring_index(F.coalesce(voice, F.lit("")), "_", 1)), F.lit(1))
    return F.coalesce(by_alias, F.when(letter.isin(codes), letter), F.when(norm.isin(codes), norm))


def local_path(url: Column, prefix: str, base: str) -> Column:
    """The path under ``base`` of a URL below ``prefix`` or of one whose path begins with ``/pods/``; other URLs stay."""
    root = base.rstrip("/") + "/"
    tail = F.ltrim(F.substring(url, len(prefix) + 1, 1 << 20), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "[?#].*$", "")
    by_prefix = F.when(F.lit(bool(prefix)) & url.startswith(prefix), F.concat(F.lit(root), tail))
    return F.coalesce(by_prefix, F.when(path.startswith("/pods/"), F.concat(F.lit(root), F.substring(path, 7, 1 << 20))), url)


def description_text(number: Column, title: Column, most: int = 5000) -> Column:
    """``chapter N of Title``, shorter where number or title is missing, cut at ``most``."""
    label = F.when(number.isNotNull(), F.concat(F.lit("chapter "), number.cast("string"))).otherwise("chapter")
    book = F.trim(F.coalesce(title, F.lit("")))
    return F.left(F.when(book == "", label).otherwise(F.concat(label, F.lit(" of "), book)), F.lit(most))


# Names by which a provider is asked for; where a response may hold an image, in the order tried.
PROVIDERS = {"kokoro": "kokoro", "kokoro-tts": "kokoro", "openai": "openai", "openai-tts": "openai", "dia": "dia", "dia-tts": "dia", "qwen3": "qwen3", "qwen3-tts": "qwen3"}
IMAGE_PATHS = (
    "$.choices[0].message.images[0].image_url.url", "$.choices[0].message.images[0].url", "$.choices[0].message.images[0].b64_json",
    "$.choices[0].message.content[0].image_base64", "$.choices[0].message.content[0].image_url", "$.choices[0].message.content", "$.choices[0].message.text",
    "$.images[0].image_url.url", "$.images[0].url", "$.images[0].b64_json", "$.content",
)


def mapped(x: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    """The value that the trimmed, lower-case key has in ``table``."""
    got = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[F.lower(F.trim(x))]
    return F.coalesce(got, F.lit(otherwise)) if otherwise is not None else got


def image_bytes(response: Column) -> Column:
    """The first image a response holds, as base64 or a data URL, in one of the places it may stand; null without any."""
    options = [F.try_to_binary(F.regexp_replace(F.get_json_object(response, p), "^data:[^,]*,", ""), F.lit("base64")) for p in IMAGE_PATHS]
    return F.coalesce(*(F.when(F.length(o) > 0, o) for o in options))


def provider_params(provider: Column, voice: Column, lang: Column, speed: Column, temperature: Column) -> Column:
    """A provider's parameters as JSON; null for a provider that isn't known."""
    audio = F.lit("mp3").alias("format")
    # The sampling parameters of one provider and the model of another.
    sampling = F.to_json(F.struct(F.lit(2048).alias("max_new_tokens"), F.lit(3.0).alias("guidance_scale"), F.lit(1.6).alias("temperature"), F.lit(0.9).alias("top_p"), F.lit(45).alias("top_k")))
    return (
        F.when(provider == "kokoro", F.to_json(F.struct(voice.alias("voice"), lang.alias("lang"), speed.alias("speed"), audio)))
        .when(provider == "openai", F.to_json(F.struct(voice.alias("voice"), F.lit("gpt-4o-mini-tts").alias("model"), audio)))
        .when(provider == "dia", sampling)
        .when(provider == "qwen3", F.to_json(F.struct(voice.alias("speaker"), audio, temperature.alias("temperature"))))
    )


def changed_chunks(chunks: Column, cleaned: Column) -> Column:
    """struct(chunks, changes): cleaned chunks where there are any, the old one where a cleaned one is null or the old blank;
    a change is (chunk_number, before, after)."""
    new = F.zip_with(chunks, cleaned, lambda a, b: F.when(X.strip(a) == "", a).otherwise(F.coalesce(b, a)))
    each = F.transform(F.arrays_zip(chunks.alias("before"), new.alias("after")), lambda p, i: F.struct((i + 1).alias("chunk_number"), p["before"].alias("before"), p["after"].alias("after")))
    return F.struct(new.alias("chunks"), F.filter(each, lambda p: p["before"] != p["after"]).alias("changes"))


def concat_samples(parts: Column, gap: Column) -> Column:
    """Sample arrays in order with ``gap`` between two of them, none behind the last."""
    n = F.size(parts)
    return F.flatten(F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, gap)).otherwise(p)))


def int_samples(samples: Column, bits: int) -> Column:
    """Whole-number samples of ``bits`` as numbers from -1 to 1."""
    return F.transform(samples, lambda v: v / float(1 << (bits - 1)))


def syllables_by(word: Column, known: Column) -> Column:
    """A word's syllables: the stresses of its dictionary entry where there is one, else by its vowels."""
    return F.coalesce(F.nullif(F.regexp_count(known, F.lit("[0-9]")), F.lit(0)), X.syllables(word))
