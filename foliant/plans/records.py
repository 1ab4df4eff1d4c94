"""Named queries over records, folders, manifests and caches, with their DuckDB equivalents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from foliant.functions import records as R, text as X, timing as T
from foliant.operators import chapters as C, queues as Q, sequences as S, timeline as L
from foliant.operators.prefix import numbered
from foliant.plans.registry import c, query, segments_sql, strip_sql, t

MODEL = "lower(trim(model_name))"

# --- folders and files ---------------------------------------------------------------------------------------------


@query(f"""SELECT pod_id, list_sort(list(DISTINCT {MODEL})) AS models, min({MODEL}) AS model FROM player_queue WHERE trim(model_name) <> '' GROUP BY
pod_id""")
def default_models(spark, d):
    """The models a pod was read with, and the first by name, which is its default."""
    rows = t(spark, d, "player_queue").where("trim(model_name) <> ''").select("pod_id", F.lower(F.trim("model_name")).alias("m"))
    return rows.groupBy("pod_id").agg(F.array_sort(F.collect_set("m")).alias("models"), F.min("m").alias("model"))


@query("""SELECT id, video_file_path, row_number() OVER (ORDER BY video_file_path, id) AS place FROM clips WHERE regexp_matches(video_file_path,
'[.]mp4$')""")
def media_files(spark, d):
    """The recordings of one kind, numbered in the order of their paths."""
    rows = t(spark, d, "clips").where(c("video_file_path").endswith(".mp4")).select("id", "video_file_path")
    return numbered(rows, [], F.left("video_file_path", F.lit(4)), ["video_file_path", "id"], "place")


@query("SELECT p_partkey, 'checkpoint-' || p_size AS name, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def checkpoint_order(spark, d):
    """Names numbered by the number at their end, not by their letters."""
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit("checkpoint-"), c("p_size").cast("string")).alias("name"))
    step = F.substring_index("name", "-", -1).try_cast("int")
    return numbered(rows, [], step, [step, "p_partkey"], "place").select("p_partkey", "name", "place")


@query("""WITH p AS (SELECT DISTINCT user_id, pod_id FROM player_queue WHERE user_id IS NOT NULL), b AS (SELECT user_id, 'pod' || id AS
pod_id, folder_path FROM books),
legacy AS (SELECT DISTINCT 'pod' || book_id AS pod_id FROM chapters WHERE src_format = 'epub'), own AS (SELECT DISTINCT user_id,
regexp_extract(video_file_path, '(pod[0-9]+)', 1) AS pod_id FROM clips)
SELECT p.user_id, p.pod_id, CASE WHEN nullif(b.folder_path, '') IS NOT NULL THEN b.folder_path WHEN legacy.pod_id IS NOT NULL THEN p.pod_id
WHEN own.pod_id IS NOT NULL THEN p.user_id || '/' || p.pod_id END AS folder
FROM p LEFT JOIN b USING (user_id, pod_id) LEFT JOIN legacy USING (pod_id) LEFT JOIN own USING (user_id, pod_id)""")
def book_folders(spark, d):
    """A pod's folder: the book's own, else the flat one, else the one below its user, whichever exists first."""
    pod = lambda x: F.concat(F.lit("pod"), x.cast("string"))
    asked = t(spark, d, "player_queue").where("user_id IS NOT NULL").select("user_id", "pod_id").distinct()
    own = t(spark, d, "books").select("user_id", pod(c("id")).alias("pod_id"), "folder_path")
    flat = t(spark, d, "chapters").where("src_format = 'epub'").select(pod(c("book_id")).alias("pod_id")).distinct().withColumn("flat", F.lit(True))
    below = t(spark, d, "clips").select("user_id", F.regexp_extract("video_file_path", "(pod[0-9]+)", 1).alias("pod_id")).distinct().withColumn("below", F.lit(True))
    j = asked.join(own, ["user_id", "pod_id"], "left").join(flat, "pod_id", "left").join(below, ["user_id", "pod_id"], "left")
    folder = F.coalesce(F.nullif("folder_path", F.lit("")), F.when(c("flat"), c("pod_id")), F.when(c("below"), F.concat_ws("/", "user_id", "pod_id")))
    return j.select("user_id", "pod_id", folder.alias("folder"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def manifest_batches(spark, d):
    return S.batches(t(spark, d, "documents").select("doc_id", "source"), ["source"], F.floor(c("doc_id") / 4096), ["doc_id"], 32)


@query("""WITH f AS (SELECT DISTINCT book_id, chapter_number, format('{:03d}_{}.mp3', chapter_number, chapter_id) AS file FROM chapters WHERE
chapter_number IS NOT NULL AND src_format = 'epub')
SELECT c.chapter_id, min(f.file) AS file FROM chapters c LEFT JOIN f ON f.book_id = c.book_id AND left(f.file, 4) = format('{:03d}_',
c.chapter_number) GROUP BY c.chapter_id""")
def chapter_media(spark, d):
    """The first recording, by name, whose number is the chapter's."""
    number = lambda n: F.format_string("%03d_", n)
    chapters = t(spark, d, "chapters")
    files = chapters.where("chapter_number IS NOT NULL AND src_format = 'epub'").select("book_id", F.concat(number(c("chapter_number")), c("chapter_id").cast("string"), F.lit(".mp3")).alias("file"))
    first = files.groupBy("book_id", F.left("file", F.lit(4)).alias("prefix")).agg(F.min("file").alias("file"))
    keyed = chapters.select("chapter_id", "book_id", F.when(c("chapter_number").isNotNull(), number(c("chapter_number"))).alias("prefix"))
    return keyed.join(first, ["book_id", "prefix"], "left").select("chapter_id", "file")


# --- checks of parsed output ---------------------------------------------------------------------------------------

OUTPUT = """WITH o AS (SELECT doc_id, list_filter(list_transform({seg}, lambda p: {strip}), lambda p: p <> '')[1:5] AS old FROM documents WHERE text IS NOT NULL) """
OLD = OUTPUT.format(seg=segments_sql("text"), strip=strip_sql("p"))


def _outputs(spark, d):
    """The first sentences of each document, and an answer about them: good, short, no list, not JSON or not all strings."""
    old = F.slice(X.filled_segments(c("text")), 1, 5)
    rows = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", old.alias("old"))
    good = F.transform("old", lambda s, i: F.concat((i + 1).cast("string"), F.lit(" "), F.left(s, F.lit(9))))
    k = c("doc_id") % 5
    short = F.slice(good, 2, 5)
    answer = F.when(k == 0, F.to_json(good)).when(k == 1, F.to_json(short)).when(k == 2, F.lit('{"a": 1}')).when(k == 3, F.lit("[1, ")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("old", lambda s: F.lit("1")), ","), F.lit("]")))
    return rows.select("doc_id", "old", answer.alias("answer"))


@query(OLD + """SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 5 IN (1, 4) AND len(old) = 0 THEN list_transform(old, lambda s, i: i ||
' ' || left(s, 9)) ELSE old END AS items,
 CASE WHEN doc_id % 5 = 1 AND len(old) > 0 THEN 'wrong length' WHEN doc_id % 5 = 2 THEN 'not a list' WHEN doc_id % 5 = 3 THEN 'not JSON' WHEN
doc_id % 5 = 4 AND len(old) > 0 THEN 'not all strings' END AS error FROM o""")
def accepted_output(spark, d):
    rows = _outputs(spark, d)
    return rows.select("doc_id", R.accepted_list(c("answer"), c("old")).alias("a")).select("doc_id", c("a.items").alias("items"), c("a.error").alias("error"))


@query(OLD + """, n AS (SELECT doc_id, old, list_transform(old, lambda s, i: CASE WHEN i = 2 THEN NULL WHEN i = 3 THEN s ELSE 'new ' || i
END) AS new FROM o)
SELECT doc_id, list_transform(new, lambda v, i: coalesce(v, old[i])) AS chunks, list_transform(list_filter(range(1, len(old) + 1), lambda i:
coalesce(new[i], old[i]) <> old[i]), lambda i: i::INT) AS changed FROM n""")
def converted_chunks(spark, d):
    """A cleaner that fails on the second chunk and leaves the third as it is."""
    old = F.slice(X.filled_segments(c("text")), 1, 5)
    new = F.transform("old", lambda s, i: F.when(i == 1, None).when(i == 2, s).otherwise(F.concat(F.lit("new "), (i + 1).cast("string"))))
    rows = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", old.alias("old")).select("doc_id", R.changed_chunks(c("old"), new).alias("x"))
    return rows.select("doc_id", c("x.chunks").alias("chunks"), F.transform("x.changes", lambda p: p["chunk_number"]).alias("changed"))


@query("""WITH n AS (SELECT book_id, chapter_number, min({'i': chapter_id, 't': coalesce(chapter_title, '')}).t AS title FROM chapters WHERE
book_id IS NOT NULL AND chapter_number IS NOT NULL GROUP BY ALL),
a AS (SELECT book_id, list(title ORDER BY chapter_number) AS old FROM n GROUP BY book_id), b AS (SELECT book_id, list(source || ' ' || doc_id
ORDER BY doc_id) AS new FROM documents WHERE book_id IS NOT NULL GROUP BY book_id)
SELECT book_id, CASE WHEN len(new) = len(old) THEN new ELSE old END AS titles FROM a LEFT JOIN b USING (book_id)""")
def zipped_titles(spark, d):
    """A book's titles, replaced one for one where as many new ones came; titles of one book's contents, so a short list."""
    chapters = t(spark, d, "chapters").where("book_id IS NOT NULL AND chapter_number IS NOT NULL")
    each = chapters.groupBy("book_id", "chapter_number").agg(F.min(F.struct("chapter_id", F.coalesce("chapter_title", F.lit("")).alias("t")))["t"].alias("t"))
    in_order = lambda place, x: F.transform(F.array_sort(F.collect_list(F.struct(place, x))), lambda e: e[x])
    old = each.groupBy("book_id").agg(in_order("chapter_number", "t").alias("old"))
    docs = t(spark, d, "documents").where("book_id IS NOT NULL").select("book_id", "doc_id", F.concat_ws(" ", "source", c("doc_id").cast("string")).alias("t"))
    new = docs.groupBy("book_id").agg(in_order("doc_id", "t").alias("new"))
    return old.join(new, "book_id", "left").select("book_id", F.coalesce(R.zip_or_keep(c("new"), c("old")), c("old")).alias("titles"))


LISTS = {"good": '[3, "1", 2, 3, " 4 ", -1, 0, "x", 1.5]', "none": "[]", "broken": "[1, 2", "text": '"1"'}


@query("SELECT * FROM (VALUES ('broken', NULL::BIGINT[]), ('good', [3, 1, 2, 4]::BIGINT[]), ('none', []::BIGINT[]), ('text', NULL)) v(kind, ids)")
def parsed_id_lists(spark, d):
    rows = spark.createDataFrame(list(LISTS.items()), "kind string, json string")
    return rows.select("kind", R.id_list(c("json")).alias("ids"))


@query("""SELECT kind, chapter_id FROM chapters, (VALUES ('good'), ('none'), ('broken'), ('text')) v(kind) WHERE kind <> 'good' OR chapter_number IN
(1, 2, 3, 4)""")
def chapter_subset(spark, d):
    """The chapters each list selects; a broken or empty list selects all."""
    rows = t(spark, d, "chapters").select("chapter_id", "chapter_number")
    parts = [S.subset_or_all(rows, "chapter_number", R.id_list(F.lit(j))).select(F.lit(k).alias("kind"), "chapter_id") for k, j in LISTS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH s AS (SELECT book_id, count(*) AS n, list(chapter_id ORDER BY chapter_id) FILTER (WHERE length(content_text) > 200) AS chosen
FROM chapters WHERE book_id IS NOT NULL GROUP BY book_id)
SELECT book_id, CASE WHEN coalesce(len(chosen), 0) < n THEN coalesce(chosen, []) END AS chosen FROM s""")
def chapter_selection(spark, d):
    rows = t(spark, d, "chapters").where("book_id IS NOT NULL").groupBy("book_id")
    s = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.length("content_text") > 200, c("chapter_id")))).alias("chosen"))
    return s.select("book_id", R.selection_or_null(c("chosen"), c("n")).alias("chosen"))


# --- fields --------------------------------------------------------------------------------------------------------


@query("""SELECT chapter_id, coalesce(nullif(chapter_title, ''), nullif(href, ''), 'chapter') AS label, CASE WHEN chapter_number IS NULL THEN 'chapter'
ELSE 'chapter ' || chapter_number END || CASE WHEN trim(coalesce(b.book_title, '')) = '' THEN '' ELSE ' of ' || trim(b.book_title) END AS
description FROM chapters c LEFT JOIN books b ON b.id = c.book_id""")
def chapter_labels(spark, d):
    books = t(spark, d, "books").select(c("id").alias("book_id"), "book_title")
    rows = t(spark, d, "chapters").select("chapter_id", "book_id", "chapter_number", "chapter_title", "href").join(books, "book_id", "left")
    return rows.select("chapter_id", R.first_filled(c("chapter_title"), c("href"), F.lit("chapter")).alias("label"), R.description_text(c("chapter_number"), c("book_title")).alias("description"))


@query("""SELECT id, list_sort(list_filter([CASE WHEN user_id <> '' THEN 'user' END, CASE WHEN command <> '' THEN 'command' END, CASE WHEN finished_at <> '' THEN 'finished' END, CASE WHEN progress_msg <> '' THEN 'message' END], lambda x: x IS NOT NULL)) AS filled FROM jobs""")
def compact_fields(spark, d):
    m = F.create_map(F.lit("user"), c("user_id"), F.lit("command"), c("command"), F.lit("finished"), c("finished_at"), F.lit("message"), c("progress_msg"))
    return t(spark, d, "jobs").select("id", F.array_sort(F.map_keys(R.compact(m))).alias("filled"))


# Media types by extension, badges by status, colours by the state of a word.
MEDIA = {"mp4": "video/mp4", "mp3": "audio/mpeg", "wav": "audio/wav", "jpg": "image/jpeg", "png": "image/png"}
BADGES = {"queued": "secondary", "paused": "secondary", "running": "primary", "awaiting_input": "warning", "success": "success", "fail": "danger", "cancelled": "dark"}
COLOURS = {"spoken": "#ffffff", "current": "#ffff00", "pending": "#808080"}


def cases_sql(x: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


@query(f"SELECT id, {cases_sql('lower(trim(status))', BADGES, repr('light'))} AS badge FROM jobs")
def status_badges(spark, d):
    return t(spark, d, "jobs").select("id", R.mapped(c("status"), BADGES, "light").alias("badge"))


@query(f"""SELECT id, {cases_sql("lower(regexp_extract(video_file_path, '([^.]*)$', 1))", MEDIA, repr('application/octet-stream'))} AS media_type,
 {cases_sql("CASE WHEN start_timestamp + 5 >= end_timestamp THEN 'spoken' WHEN start_timestamp + 5 >= start_timestamp THEN 'current' ELSE 'pending' END", COLOURS)}
AS colour FROM clips""")
def clip_media(spark, d):
    at = c("start_timestamp") + 5
    state = F.when(at >= c("end_timestamp"), "spoken").when(at >= c("start_timestamp"), "current").otherwise("pending")
    extension = F.regexp_extract("video_file_path", "([^.]*)$", 1)
    return t(spark, d, "clips").select("id", R.mapped(extension, MEDIA, "application/octet-stream").alias("media_type"), R.mapped(state, COLOURS).alias("colour"))


NAMES = (("Kokoro", "en-us", "af_bella"), (" openai-tts ", "xx", "pm_alex"), ("DIA", "fr-fr", ""), ("qwen3-tts", "e", "unknown"), ("other", "zz", "q_x"), (None, None, None))
# Language codes of one provider, and its aliases.
CODES, ALIASES = list("abefhijpz"), {"en-us": "a", "en-gb": "b", "es": "e", "fr-fr": "f", "hi": "h", "it": "i", "pt-br": "p", "ja": "j", "zh": "z"}


@query("""SELECT * FROM (VALUES (0, 'kokoro', 'a', '{"voice":"af_bella","lang":"a","speed":1.0,"format":"mp3"}'), (1, 'openai', 'p',
'{"voice":"pm_alex","model":"gpt-4o-mini-tts","format":"mp3"}'),
 (2, 'dia', 'f', '{"max_new_tokens":2048,"guidance_scale":3.0,"temperature":1.6,"top_p":0.9,"top_k":45}'), (3, 'qwen3', 'e',
'{"speaker":"unknown","format":"mp3","temperature":0.7}'), (4, NULL, NULL, NULL), (5, NULL, NULL, NULL)) v(k, provider, code, params)""")
def voice_params(spark, d):
    rows = spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "k int, name string, lang string, voice string")
    rows = rows.select("k", R.mapped(c("name"), R.PROVIDERS).alias("provider"), R.lang_code(c("lang"), c("voice"), ALIASES, CODES).alias("code"), "voice")
    return rows.select("k", "provider", "code", R.provider_params(c("provider"), c("voice"), c("code"), F.lit(1.0), F.lit(0.7)).alias("params"))


VOICES = (("Bella", "Nicole", "Adam"), ("af_bella", "af_nicole", "am_adam"))


@query("WITH own AS (SELECT unnest(['Bella', 'Nicole', 'Adam']) AS name, unnest(['af_bella', 'af_nicole', 'am_adam']) AS code), m AS (SELECT DISTINCT " + MODEL + " AS name FROM player_queue WHERE trim(model_name) <> '') SELECT name, code, false AS custom FROM own UNION ALL SELECT name, name, true FROM m")
def all_voices(spark, d):
    """The provider's own voices, zipped from names and codes, and behind them those trained by users."""
    own = spark.range(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, VOICES[0])).alias("name"), F.array(*map(F.lit, VOICES[1])).alias("code"))).alias("v")).select("v.name", "v.code", F.lit(False).alias("custom"))
    trained = t(spark, d, "player_queue").where("trim(model_name) <> ''").select(F.lower(F.trim("model_name")).alias("name")).distinct()
    return own.unionByName(trained.select("name", c("name").alias("code"), F.lit(True).alias("custom")))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN '/data/pods/' || regexp_replace(video_url, '^/pods/', '') WHEN id % 3 = 1 AND video_url LIKE
'/pods/%' THEN '/data/pods/' || substr(video_url, 7) WHEN id % 3 = 1 THEN 'https://h.example' || video_url ELSE 'https://other.example/x' ||
video_url END AS path
FROM clips WHERE video_url LIKE '/pods/%'""")
def local_paths(spark, d):
    k = c("id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://cdn.example/a/"), F.substring("video_url", 7, 1 << 20))).when(k == 1, F.concat(F.lit("https://h.example"), c("video_url"))).otherwise(F.concat(F.lit("https://other.example/x"), c("video_url")))
    return t(spark, d, "clips").where(c("video_url").startswith("/pods/")).select("id", R.local_path(url, "https://cdn.example/a", "/data/pods").alias("path"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ':22a' WHEN 2 THEN p_brand ELSE p_brand || ':1:2' END AS
host, CASE p_partkey % 4 WHEN 2 THEN p_size ELSE 22 END::INT AS port FROM part""")
def host_ports(spark, d):
    k = c("p_partkey") % 4
    x = F.when(k == 0, c("p_brand")).when(k == 1, F.concat(c("p_brand"), F.lit(":22a"))).when(k == 2, F.concat(c("p_brand"), F.lit(":"), c("p_size").cast("string"))).otherwise(F.concat(c("p_brand"), F.lit(":1:2")))
    return t(spark, d, "part").select("p_partkey", X.host_port(x).alias("h")).select("p_partkey", c("h.host").alias("host"), c("h.port").alias("port"))


@query("SELECT chapter_id, to_base64(encode(coalesce(chapter_title, ''))) AS code, coalesce(chapter_title, '') AS back FROM chapters")
def title_codes(spark, d):
    code = F.regexp_replace(F.base64(F.encode(F.coalesce("chapter_title", F.lit("")), "UTF-8")), "[\\r\\n]", "")
    rows = t(spark, d, "chapters").select("chapter_id", code.alias("code"))
    return rows.select("chapter_id", "code", F.decode(F.try_to_binary("code", F.lit("base64")), "UTF-8").alias("back"))


@query("""SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE coalesce(pod_title, '') END AS image FROM clips WHERE length(pod_title) > 0""")
def response_images(spark, d):
    """Images (here: titles) in answers of several shapes; one shape holds none."""
    code = F.regexp_replace(F.base64(F.encode("pod_title", "UTF-8")), "[\\r\\n]", "")
    url, k = F.concat(F.lit("data:image/png;base64,"), code), c("id") % 4
    nested = F.concat(F.lit('{"choices":[{"message":{"images":[{"image_url":{"url":"'), url, F.lit('"}}]}}]}'))
    listed = F.concat(F.lit('{"images":[{"b64_json":"'), code, F.lit('"}]}'))
    answer = F.when(k == 0, nested).when(k == 1, listed).when(k == 2, F.concat(F.lit('{"content":"'), url, F.lit('"}'))).otherwise(F.lit('{"choices":[]}'))
    return t(spark, d, "clips").where("length(pod_title) > 0").select("id", F.decode(R.image_bytes(answer), "UTF-8").alias("image"))


@query("""SELECT chapter_id, contains(',' || lower(coalesce(lang, '')) || ',' || src_format || ',', ',epub,') OR lower(coalesce(lang, '')) IN ('fr',
'epub') AS hit FROM chapters WHERE src_format IS NOT NULL""")
def class_overlap(spark, d):
    """Whether the classes of an element meet the ignored ones, in any case."""
    classes = F.split(F.lower(F.concat_ws(" ", F.coalesce("lang", F.lit("")), "src_format")), " ")
    return t(spark, d, "chapters").where("src_format IS NOT NULL").select("chapter_id", F.arrays_overlap(classes, F.array(F.lit("fr"), F.lit("epub"))).alias("hit"))


# --- books and jobs ------------------------------------------------------------------------------------------------


@query(f"""WITH me AS (SELECT min(user_id) AS me FROM books), e AS (SELECT book_id, count(*) AS n_episodes FROM chapters WHERE
{strip_sql("coalesce(content_text, '')")} <> '' GROUP BY book_id), m AS (SELECT pod_id, min({MODEL}) AS model FROM player_queue WHERE
trim(model_name) <> '' GROUP BY pod_id)
SELECT b.id, coalesce(nullif(trim(book_title), ''), regexp_extract(folder_path, '([^/]*)$', 1)) AS title, m.model, n_episodes, b.user_id = me
AS is_owner, visibility
FROM books b, me JOIN e ON e.book_id = b.id JOIN m ON m.pod_id = 'pod' || b.id WHERE b.user_id = me OR visibility = 1""")
def library_view(spark, d):
    """The visible books that have a model and at least one chapter with text."""
    books = t(spark, d, "books")
    me = books.agg(F.min("user_id").alias("me"))
    episodes = t(spark, d, "chapters").where(X.strip(c("content_text")) != "").groupBy(c("book_id").alias("id")).agg(F.count("*").alias("n_episodes"))
    models = default_models(spark, d).select(F.substring("pod_id", 4, 20).try_cast("long").alias("id"), "model")
    seen = books.crossJoin(F.broadcast(me)).where((c("user_id") == c("me")) | (c("visibility") == 1)).join(episodes, "id").join(models, "id")
    title = R.first_filled(F.trim("book_title"), F.regexp_extract("folder_path", "([^/]*)$", 1))
    return seen.select("id", title.alias("title"), "model", "n_episodes", (c("user_id") == c("me")).alias("is_owner"), "visibility")


@query("""WITH x AS (SELECT user_id, id, folder_path FROM books WHERE id % 3 = 0 AND user_id IS NOT NULL) SELECT 'deleted' AS state, id, folder_path FROM x UNION ALL SELECT 'kept', id, folder_path FROM books WHERE NOT (id % 3 = 0 AND user_id IS NOT NULL)""")
def deleted_books(spark, d):
    """Every third book is asked for by its owner, and all others by somebody else."""
    books = t(spark, d, "books")
    asked = books.select("id", F.when(c("id") % 3 == 0, c("user_id")).otherwise("nobody").alias("user_id"))
    kept, gone = Q.delete_owned(books, asked)
    return gone.select(F.lit("deleted").alias("state"), "id", "folder_path").unionByName(kept.select(F.lit("kept").alias("state"), "id", "folder_path"))


@query("""WITH n AS (SELECT doc_id, source FROM documents WHERE doc_kind = 'letter'), k AS (SELECT doc_id, source, row_number() OVER (ORDER
BY doc_id) AS r FROM n)
SELECT id, pod_title, json_array_length(CASE WHEN json_valid(transcript) THEN transcript END)::INT AS n_words FROM clips UNION ALL SELECT
(SELECT max(id) FROM clips) + r, source, 2 FROM k WHERE source IS NOT NULL""")
def inserted_clips(spark, d):
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(a).alias("start"), F.lit(a + 0.5).alias("end")) for w, a in (("one", 0.0), ("two", 0.6))))
    new = t(spark, d, "documents").where("doc_kind = 'letter'").select(c("doc_id").alias("seq"), F.lit("u").alias("user_id"), c("source").alias("pod_title"), words.alias("words"))
    return Q.insert_clips(t(spark, d, "clips"), new).select("id", "pod_title", F.json_array_length("transcript").alias("n_words"))


@query("SELECT id, status FROM jobs ORDER BY id DESC")
def jobs_newest(spark, d):
    return t(spark, d, "jobs").orderBy(F.desc("id")).select("id", "status")


@query("SELECT chapter_id FROM chapters WHERE book_id = 1 ORDER BY chapter_number, chapter_id LIMIT 10 OFFSET 10")
def episode_page(spark, d):
    """The second page of the first book's list."""
    return S.page(t(spark, d, "chapters").where("book_id = 1"), ["chapter_number", "chapter_id"], 2).select("chapter_id")


@query("""SELECT pod_id, row_number() OVER (ORDER BY try_cast(substr(pod_id, 4) AS BIGINT)) AS place FROM (SELECT DISTINCT pod_id FROM player_queue
WHERE pod_id IS NOT NULL)""")
def pods_by_number(spark, d):
    """Keys that end in a number, in the order of the numbers."""
    rows = t(spark, d, "player_queue").where("pod_id IS NOT NULL").select("pod_id").distinct().withColumn("k", F.substring("pod_id", 4, 20).try_cast("long"))
    return numbered(rows, [], F.floor(c("k") / 4096), ["k", "pod_id"], "place").select("pod_id", "place").orderBy("place")


@query("""WITH gone AS (SELECT id FROM jobs WHERE status = 'cancelled') SELECT id, row_number() OVER (ORDER BY id) AS place FROM jobs WHERE id NOT IN
(SELECT id FROM gone)""")
def remaining_jobs(spark, d):
    jobs = t(spark, d, "jobs").select("id", "status")
    left = S.without(jobs.select("id"), jobs.where("status = 'cancelled'"), "id")
    return numbered(left, [], F.substring("id", 1, 11), ["id"], "place")


@query("SELECT count(*) FILTER (WHERE lower(trim(chapter_title)) LIKE 'chapter%') AS n_titled, count(*) AS n FROM chapters")
def numbered_titles(spark, d):
    return t(spark, d, "chapters").agg(F.count_if(F.lower(F.trim("chapter_title")).startswith("chapter")).alias("n_titled"), F.count("*").alias("n"))


@query("""WITH k AS (SELECT book_id, min(doc_id) AS doc_id FROM documents WHERE doc_kind = 'summary' AND book_id IS NOT NULL GROUP BY book_id) SELECT chapter_id, coalesce(x.text, c.content_text) AS text FROM chapters c LEFT JOIN k ON k.book_id = c.book_id LEFT JOIN documents x ON x.doc_id = k.doc_id""")
def source_text(spark, d):
    """A chapter's text from its source where that is there, else the one it has."""
    docs = t(spark, d, "documents").where("doc_kind = 'summary' AND book_id IS NOT NULL")
    first = docs.groupBy("book_id").agg(F.min("doc_id").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id").select("book_id", "text")
    return t(spark, d, "chapters").select("chapter_id", "book_id", "content_text").join(first, "book_id", "left").select("chapter_id", F.coalesce("text", "content_text").alias("text"))


@query("""WITH k AS (SELECT user_id, id, (1000 * start_timestamp)::BIGINT % 100000 AS a, greatest(0, (1000 * (end_timestamp -
start_timestamp))::BIGINT) AS n FROM clips WHERE user_id IS NOT NULL AND start_timestamp IS NOT NULL AND end_timestamp IS NOT NULL),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT id, (max(a - before) OVER (PARTITION BY user_id ORDER BY id) + before)::BIGINT AS begins, (max(a - before) OVER (PARTITION BY user_id
ORDER BY id) + before + n)::BIGINT AS ends FROM s""")
def service_times(spark, d):
    """When each user's clips would be rendered, one at a time in the order of their ids."""
    ms = lambda x: F.round(1000 * x).cast("long")
    rows = t(spark, d, "clips").where("user_id IS NOT NULL AND start_timestamp IS NOT NULL AND end_timestamp IS NOT NULL")
    rows = rows.select("user_id", "id", (ms(c("start_timestamp")) % 100000).alias("a"), F.greatest(F.lit(0), ms(c("end_timestamp") - c("start_timestamp"))).alias("n"))
    return S.fifo_service(rows, ["user_id"], F.floor(c("id") / 4096), ["id"], c("a"), c("n")).select("id", "begins", "ends")


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, round(avg(value), 6) AS loss FROM events WHERE value IS NOT NULL
GROUP BY ALL),
b AS (SELECT *, min(loss) OVER w AS best, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM e WINDOW w AS (PARTITION BY user_id
ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN n END) OVER (PARTITION BY user_id ORDER BY day) AS last FROM b),
s AS (SELECT *, min(CASE WHEN n - last >= 3 THEN n END) OVER (PARTITION BY user_id) AS stop FROM l)
SELECT user_id, min({'l': loss, 'd': day}).d AS best_epoch, min(loss) AS best_loss, max(CASE WHEN n = stop THEN day END) AS stopped_at FROM s
WHERE stop IS NULL OR n <= stop GROUP BY user_id""")
def training_runs(spark, d):
    """Each user as a training run, each day as an epoch with its mean loss."""
    losses = t(spark, d, "events").where("value IS NOT NULL").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return S.early_stopping(losses, "user_id", "day", "loss", 3)


@query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT (n - greatest(1, floor(n * 0.05)))::BIGINT AS n_train, greatest(1, floor(n *
0.05))::BIGINT AS n_val FROM n""")
def split_sizes(spark, d):
    """Sizes of a split drawn by hash; which rows are drawn is a matter of the hash."""
    parts = S.train_val_split(t(spark, d, "documents").select("doc_id"), "doc_id", 0.05)
    return parts.agg(F.count_if(c("part") == "train").alias("n_train"), F.count_if(c("part") == "val").alias("n_val"))


@query("""WITH j AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM
jobs WHERE status = 'queued') SELECT id, CASE WHEN n < 8 THEN 8 // n + (k < 8 % n)::INT ELSE 1 END::INT AS copies FROM j""")
def batch_copies(spark, d):
    """How often each waiting job of a user is tried at once when eight fit."""
    jobs = t(spark, d, "jobs").where("status = 'queued'").select("user_id", "id")
    placed = numbered(jobs, ["user_id"], F.substring("id", 1, 11), ["id"], "k").join(jobs.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    return placed.select("id", R.copies(c("k") - 1, c("n"), 8).alias("copies"))


@query("""WITH p AS (SELECT event_id, value, floor(((event_id % 12) / 12::DOUBLE + (event_id % 17) / 17::DOUBLE / 12::DOUBLE) * 100)::INT AS
pct FROM events WHERE value IS NOT NULL),
q AS (SELECT *, floor(value * 60 / (pct / 100::DOUBLE) - value * 60)::BIGINT AS s FROM p WHERE pct > 0)
SELECT event_id, pct, CASE WHEN s >= 3600 THEN format('~{}h {}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('~{}m {}s', s // 60, s
% 60) ELSE format('~{}s', s) END AS eta FROM q UNION ALL SELECT event_id, pct, '—' FROM p WHERE pct <= 0""")
def overall_progress(spark, d):
    """Percent done of a book's chapters with the chunks of the chapter in work, and the time left."""
    chapter, done = c("event_id") % 12 + 1, c("event_id") % 17
    rows = t(spark, d, "events").where("value IS NOT NULL").select("event_id", T.overall_percent(chapter, F.lit(12), done, F.lit(17)).alias("pct"), "value")
    return rows.select("event_id", "pct", F.when(c("pct") > 0, T.eta(c("value") * 60 / (c("pct") / 100.0) - c("value") * 60)).otherwise("—").alias("eta"))


# --- words and samples ---------------------------------------------------------------------------------------------

WORDS_SQL = """WITH w AS (SELECT id, list_transform(from_json(CASE WHEN json_valid(transcript) THEN transcript END, '["JSON"]'), lambda x: coalesce(x->>'word', '')) AS words FROM clips) """


@query(WORDS_SQL + "SELECT id, words[least(id % 5, id % 7) + 1 : greatest(id % 5, id % 7) + 1] AS words FROM w WHERE len(words) > 0")
def word_ranges(spark, d):
    words = F.transform(F.from_json("transcript", L.WORDS), lambda w: F.coalesce(w["word"], F.lit("")))
    rows = t(spark, d, "clips").select("id", words.alias("w")).where(F.size("w") > 0)
    return rows.select("id", R.word_range(c("w"), (c("id") % 5).cast("int"), (c("id") % 7).cast("int")).alias("words"))


KNOWN = {"radio": "R EY1 D IY0 OW2", "the": "DH AH0", "science": "S AY1 AH0 N S"}


@query("""SELECT p_partkey, list_sum(list_transform(string_split(lower(p_name || ' radio the science'), ' '), lambda v: CASE v WHEN 'radio' THEN 3 WHEN 'the' THEN 1 WHEN 'science' THEN 2 ELSE greatest(len(regexp_extract_all(v, '[aeiouy]+')), 1) END))::BIGINT AS n_syllables FROM part""")
def known_syllables(spark, d):
    known = F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv))
    words = F.split(F.lower(F.concat(c("p_name"), F.lit(" radio the science"))), " ")
    total = F.aggregate(F.transform(words, lambda w: R.syllables_by(w, known[w])), F.lit(0), lambda a, v: a + v)
    return t(spark, d, "part").select("p_partkey", total.cast("long").alias("n_syllables"))


@query(r"""SELECT id, round(end_timestamp - start_timestamp, 3) AS seconds, round(len(words) / nullif((end_timestamp - start_timestamp) / 60, 0), 3) AS words_per_min FROM (SELECT c.*, w.words FROM clips c JOIN w USING (id)) WHERE end_timestamp > start_timestamp AND len(words) > 0""".replace("SELECT id, round(end", WORDS_SQL + "SELECT id, round(end", 1))
def clip_speaking_rate(spark, d):
    secs = c("end_timestamp") - c("start_timestamp")
    rows = t(spark, d, "clips").select("id", secs.alias("s"), F.size(F.from_json("transcript", L.WORDS)).alias("n")).where("s > 0 AND n > 0")
    return rows.select("id", F.round("s", 3).alias("seconds"), F.round(F.try_divide(c("n"), c("s") / 60), 3).alias("words_per_min"))


@query("""SELECT vec_id, len(embedding) * 3 + 8 AS n, round(list_sum(list_transform(embedding, lambda v: greatest(-1.0, least(1.0, v * 20))))::DOUBLE * 3, 2) AS total FROM embeddings""")
def joined_samples(spark, d):
    """Three chunks with silence between them, clipped; loud, so that clipping acts."""
    loud = F.transform("embedding", lambda v: (v.cast("double") * 20))
    parts = T.clip_samples(R.concat_samples(F.array(loud, loud, loud), F.array_repeat(F.lit(0.0), 4)))
    return t(spark, d, "embeddings").select("vec_id", parts.alias("p")).select("vec_id", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v.cast("double")), 2).alias("total"))


@query("SELECT event_id, round((event_id % 65536 - 32768) / 32768.0, 6)::DOUBLE AS sample FROM events")
def whole_samples(spark, d):
    x = R.int_samples(F.array(c("event_id") % 65536 - 32768), 16)
    return t(spark, d, "events").select("event_id", F.round(x[0], 6).alias("sample"))


# --- requests and attempts -----------------------------------------------------------------------------------------

KEY = """sha256('{' || CASE WHEN lang IS NULL THEN '' ELSE '"lang":"' || lang || '",' END || '"source":"' || source || '"}')"""


def _requests(spark, d):
    return t(spark, d, "documents").where("source IS NOT NULL").select("doc_id", R.cache_key({"source": c("source"), "lang": c("lang")}).alias("key"))


@query(f"SELECT doc_id, {KEY} AS key FROM documents WHERE source IS NOT NULL")
def cache_keys(spark, d):
    return _requests(spark, d)


@query(f"""WITH r AS (SELECT doc_id, {KEY} AS key FROM documents WHERE source IS NOT NULL), s AS (SELECT key, arg_max('answer ' || doc_id,
doc_id) AS response FROM r WHERE doc_id % 2 = 0 GROUP BY key)
SELECT doc_id, response FROM r LEFT JOIN s USING (key)""")
def cached_responses(spark, d):
    """Answers to every second request are put into an empty cache, then all requests are looked up."""
    asked = _requests(spark, d)
    answers = asked.where("doc_id % 2 = 0").select("key", F.concat(F.lit("answer "), c("doc_id").cast("string")).alias("response"), c("doc_id").alias("seq"))
    empty = spark.createDataFrame([], "key string, response string")
    return S.cached(asked, S.stored(empty, answers)).select("doc_id", "response")


@query("""WITH k AS (SELECT user_id AS chunk_idx, (event_id // 2 % 7 + 1)::INT AS attempt, round(value / 200, 6) AS silence FROM events WHERE
value IS NOT NULL)
SELECT chunk_idx, attempt, count(*) AS n_candidates, min(silence) AS least_silence, bool_or(silence <= 0.1) AS accepted FROM k GROUP BY ALL""")
def attempt_log(spark, d):
    """One line an attempt at a chunk: candidates made, their least silence, whether one was good enough."""
    rows = t(spark, d, "events").where("value IS NOT NULL").select(c("user_id").alias("chunk_idx"), (F.floor(c("event_id") / 2) % 7 + 1).cast("int").alias("attempt"), F.round(c("value") / 200, 6).alias("silence"))
    return L.attempt_log(rows)


@query("""WITH v AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, (e.vec_id % 40)::DOUBLE AS seconds FROM embeddings e), p AS (SELECT
a.vec_id, a.v AS va, b.v AS vb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.seconds >= 10 AND b.seconds >= 10)
SELECT vec_id, round(list_cosine_similarity(va[1:least(len(va), 30)], vb[1:least(len(vb), 30)]), 5) AS score FROM p""")
def speaker_pairs(spark, d):
    """Neighbouring recordings of at least ten seconds, compared by their first thirty (here: values of the vector)."""
    v = t(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 30).alias("v"), (c("vec_id") % 40).alias("seconds")).where("seconds >= 10")
    nxt = v.select((c("vec_id") - 1).alias("vec_id"), c("v").alias("v2"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(T.cosine(c("v"), c("v2")), 5).alias("score"))


# --- books as files ------------------------------------------------------------------------------------------------

@F.pandas_udf(BinaryType())
def _small_epub(number: pd.Series, title: pd.Series, lang: pd.Series) -> pd.Series:
    """A book of two documents, the second out of the reading order, with a nested table of contents."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def one(n, title, lang) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b/book.opf"/></rootfiles></container>')
            z.writestr(
                "b/book.opf",
                f"""<package xmlns:opf="o" xmlns:dc="d"><metadata><dc:title>{escape(title)}</dc:title><dc:creator opf:ROLE="aut"
opf:file-as="W, A">A  W</dc:creator><dc:subject>s{n % 3}</dc:subject><dc:subject> </dc:subject>
                <dc:language>{escape(lang)}</dc:language><dc:identifier>u{n}</dc:identifier><dc:identifier
opf:scheme="ISBN">{n}</dc:identifier></metadata><manifest><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/>
                <item id="n" href="n.xhtml" media-type="application/xhtml+xml"/><item id="t" href="t.ncx"
media-type="application/x-dtbncx+xml"/><item id="e" href="cover0.png" media-type="image/png"/><item id="i" href="my-cover.png"
media-type="image/png"/>
                <item id="j" href="z.png" media-type="image/png"/></manifest><spine>{'' if n % 5 == 0 else '<itemref idref="a"/>'}<itemref
idref="n" linear="NO"/></spine></package>""",
            )
            z.writestr("b/t.ncx", "<ncx><navMap><navPoint><navLabel><text>Part</text></navLabel><navPoint><navLabel><text>One</text></navLabel><content src='a%20b.xhtml#x'/></navPoint></navPoint></navMap></ncx>" if n % 2 else "<ncx/>")
            z.writestr("b/a b.xhtml", f"<p id='x'>{n}</p>")
            z.writestr("b/cover0.png", b"")
            z.writestr("b/my-cover.png", b"1")
            z.writestr("b/z.png", b"2")
        return out.getvalue()

    return pd.Series([one(int(n), t, g) for n, t, g in zip(number, title, lang)])


@query("""WITH c AS (SELECT chapter_id AS n, trim(coalesce(lang, 'und')) AS lang FROM chapters)
SELECT n, CASE WHEN n % 5 > 0 THEN 'opf' WHEN n % 2 = 1 THEN 'ncx' END AS source, CASE WHEN n % 2 = 1 THEN 'One' END AS title, CASE WHEN n %
5 = 0 AND n % 2 = 0 THEN NULL WHEN n % 2 = 1 THEN 'b/a b.xhtml#x' ELSE 'b/a b.xhtml' END AS href,
 CASE WHEN n % 2 = 1 THEN 'x' END AS anchor, CASE WHEN n % 5 > 0 OR n % 2 = 1 THEN '<p id=''x''>' || n || '</p>' END AS html, 'Book ' || n AS
book_title, 'A W/aut/W, A' AS creator, 's' || n % 3 AS subjects, lang AS languages, n::VARCHAR AS isbn,
 'b/my-cover.png' AS cover_href, (CASE WHEN n % 5 > 0 THEN 0 WHEN n % 2 = 1 THEN 1 ELSE 3 END)::INT AS n_warnings FROM c""")
def epub_entries(spark, d):
    """A small book is set from each chapter row and read back: contents, slices, metadata, cover, warnings."""
    from foliant.sources.epub import parse_books

    rows = t(spark, d, "chapters").select(c("chapter_id").cast("string").alias("path"), _small_epub(c("chapter_id"), F.concat(F.lit("Book "), c("chapter_id").cast("string")), F.trim(F.coalesce("lang", F.lit("und")))).alias("content"))
    x = parse_books(rows)
    creator = F.concat_ws("/", F.col("metadata.creators")[0]["name"], F.col("metadata.creators")[0]["role"], F.col("metadata.creators")[0]["file_as"])
    return x.select(
        c("file").cast("long").alias("n"), "source", "title", "href", "anchor", "html", c("metadata.title").alias("book_title"), creator.alias("creator"), F.array_join("metadata.subjects", ",").alias("subjects"),
        F.array_join("metadata.languages", ",").alias("languages"), c("metadata.isbn").alias("isbn"), "cover_href", F.size("warnings").alias("n_warnings"),
    )


@query(r"""WITH c AS (SELECT book_id, chapter_number,
min({'i': chapter_id, 't': coalesce(nullif(chapter_title, ''), 'Chapter ' || chapter_number)}).t AS title FROM chapters WHERE book_id IS NOT
NULL AND chapter_number IS NOT NULL GROUP BY ALL),
g AS (SELECT book_id, list(title ORDER BY chapter_number) AS titles FROM c GROUP BY book_id)
SELECT b.id AS channel, coalesce(nullif(book_title, ''), 'Untitled Podcast') AS title, coalesce(user_id, 'Unknown') AS author, CASE WHEN b.id
% 2 = 0 THEN 'https://h.example/' || b.id || '?a=1&b=2' END AS link, titles AS item_titles, len(titles)::INT AS n_items
FROM books b JOIN g ON g.book_id = b.id WHERE NOT regexp_matches(coalesce(book_title, '') || array_to_string(titles, ''),
'[\x{1}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]')""")
def feed_channels(spark, d):
    """A feed of each book's chapters, written and read back; books whose titles hold characters that XML forbids are left out."""
    from foliant.sources import files

    forbidden = r"[\x{1}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]"
    chapters = t(spark, d, "chapters").where("book_id IS NOT NULL AND chapter_number IS NOT NULL")
    label = R.first_filled(c("chapter_title"), F.concat(F.lit("Chapter "), c("chapter_number").cast("string")))
    each = chapters.groupBy(c("book_id").alias("channel"), c("chapter_number").alias("pos")).agg(F.min(F.struct("chapter_id", label.alias("t")))["t"].alias("title"))
    episodes = each.select("channel", "pos", c("pos").alias("number"), "title", F.concat_ws("/", F.lit("https://h.example"), c("channel").cast("string"), F.format_string("%03d.mp3", "pos")).alias("url"), F.lit(None).cast("long").alias("bytes"), F.lit("Mon, 01 Jan 2024 00:00:00 +0000").alias("pub_date"), F.lit("1:00").alias("duration"), F.lit("d & <e>").alias("description"), F.lit("a").alias("author"))
    bad = episodes.where(c("title").rlike(forbidden)).select("channel").distinct()
    books = t(spark, d, "books").where(~F.coalesce("book_title", F.lit("")).rlike(forbidden)).select(
        c("id").alias("channel"), c("book_title").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("en").alias("language"), c("user_id").alias("author"), F.lit(None).cast("string").alias("pub_date"), F.lit(None).cast("string").alias("build_date"),
        F.when(c("id") % 2 == 0, F.concat(F.lit("https://h.example/"), c("id").cast("string"), F.lit("?a=1&b=2"))).alias("link"), F.lit("https://h.example/c.png").alias("image"), F.lit(False).alias("explicit"),
    )
    made = files.feeds(books.join(bad, "channel", "left_anti"), episodes)
    return files.parsed_feeds(made).select("channel", "title", "author", "link", "item_titles", F.size("item_urls").alias("n_items"))


@query("""SELECT b.id AS book_id, nullif(book_title, '') AS title, coalesce(n, 0)::INT AS n_chapters, last FROM books b LEFT JOIN (SELECT book_id, count(*) AS n, max({'a': chapter_number, 'i': chapter_id, 't': chapter_title}).t AS last FROM chapters WHERE chapter_number IS NOT NULL GROUP BY book_id) c ON c.book_id = b.id""")
def book_documents(spark, d):
    """A document of each book with its chapters, written as JSON and read back."""
    from foliant.sources import files

    books = t(spark, d, "books").select(c("id").alias("book_id"), c("book_title").alias("title"), F.array(F.lit("w")).alias("_warnings"))
    made = files.book_documents(books, t(spark, d, "chapters").where("chapter_number IS NOT NULL"))
    back = F.from_json("json", "title string, chapters array<struct<chapter_number:int,chapter_title:string,href:string>>")
    return made.select("book_id", back.alias("b")).select("book_id", c("b.title").alias("title"), F.greatest(F.size(F.coalesce("b.chapters", F.array())), F.lit(0)).alias("n_chapters"), F.try_element_at("b.chapters", F.lit(-1))["chapter_title"].alias("last"))


# --- state folds ---------------------------------------------------------------------------------------------------

# What an event makes of a visitor's state.
MOVES = {
    ("new", "view"): "looking", ("looking", "click"): "choosing", ("choosing", "purchase"): "buyer", ("buyer", "view"): "looking",
    ("looking", "purchase"): "buyer", ("choosing", "view"): "looking", ("buyer", "click"): "choosing", ("new", "click"): "choosing",
}
MOVE_SQL = "CASE r.state || ' ' || f.event_type " + " ".join(f"WHEN '{s} {e}' THEN '{to}'" for (s, e), to in MOVES.items()) + " ELSE r.state END"


@query(f"""WITH RECURSIVE f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'new' AS state FROM events UNION ALL SELECT f.user_id, f.k, {MOVE_SQL} FROM r JOIN f ON
f.user_id = r.user_id AND f.k = r.k + 1)
SELECT user_id, arg_max(state, k) AS state, max(k) AS n FROM r GROUP BY user_id""")
def visitor_states(spark, d):
    return S.fold_states(t(spark, d, "events"), "user_id", F.to_date("ts"), ["ts", "event_id"], "event_type", MOVES, "new")
