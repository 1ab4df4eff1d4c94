"""Named queries over the tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import markup as M, text as X, timing as T
from foliant.operators import chapters as C, queues as Q, timeline as L
from foliant.operators.layout import spread
from foliant.operators.prefix import numbered
from foliant.operators.similarity import top_similar
from foliant.plans.registry import BLANK, ORACLE, QUERIES, c, query, segments_sql, slug_sql, strip_sql, t, words_sql

# --- chapters ------------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT book_id, chapter_id, chapter_number, chapter_title, coalesce({words_sql('content_text')}, 0) AS n FROM chapters
WHERE book_id IS NOT NULL)
SELECT book_id, count(*) AS n_chapters, sum(n)::BIGINT AS total_words, floor(sum(n) / count(*) + 0.5)::BIGINT AS mean_words,
 (array_agg(chapter_id ORDER BY n DESC, chapter_number, chapter_id))[1] AS longest_id, (array_agg(chapter_id ORDER BY n, chapter_number,
chapter_id))[1] AS shortest_id,
 (array_agg(chapter_title ORDER BY chapter_number, chapter_id))[1] AS first_title, (array_agg(chapter_title ORDER BY chapter_number DESC,
chapter_id DESC))[1] AS last_title
FROM w GROUP BY book_id""")
def chapter_summary(spark, d):
    return C.summarise(t(spark, d, "chapters"))


@query(f"SELECT chapter_id, coalesce({words_sql('content_text')}, 0)::BIGINT AS n_words FROM chapters")
def chapter_word_counts(spark, d):
    return t(spark, d, "chapters").select("chapter_id", X.word_count(c("content_text")).alias("n_words"))


@query("""SELECT book_id, chapter_id, chapter_number, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, chapter_id)::BIGINT AS
new_number
FROM chapters WHERE chapter_number IS NOT NULL AND book_id IS NOT NULL""")
def chapter_renumber(spark, d):
    return C.renumber(t(spark, d, "chapters")).select("book_id", "chapter_id", "chapter_number", "new_number")


@query(f"""WITH r AS (SELECT book_id, chapter_id, chapter_number, chapter_title, href, {strip_sql("coalesce(content_text, '')")} AS body FROM
chapters WHERE chapter_number IS NOT NULL AND book_id IS NOT NULL),
w AS (SELECT *, (length(body) >= 100)::INT AS long FROM r),
g AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY book_id ORDER BY chapter_number, chapter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING), 0) AS behind, sum(long) OVER (PARTITION BY book_id) AS n_long FROM w),
p AS (SELECT *, least(behind, n_long - 1) AS grp FROM g WHERE n_long > 0)
SELECT book_id, (grp + 1)::BIGINT AS new_number, max(CASE WHEN long = 1 THEN chapter_id END) AS chapter_id, (array_agg(chapter_title ORDER BY
long DESC, chapter_number DESC, chapter_id DESC))[1] AS chapter_title,
 coalesce(nullif(max(CASE WHEN long = 1 THEN href END), ''), (array_agg(href ORDER BY chapter_number, chapter_id) FILTER (WHERE long = 0 AND
href <> '' AND behind = grp))[1]) AS href,
 string_agg(body, ' ' ORDER BY chapter_number, chapter_id) FILTER (WHERE body <> '') AS content_text FROM p GROUP BY book_id, grp""")
def merge_short_chapters(spark, d):
    return C.merge_short(t(spark, d, "chapters"))


@query(f"""SELECT chapter_id, left({strip_sql('content_text')}, 200) AS preview, length({strip_sql('content_text')})::BIGINT AS n_chars,
left(translate(content_text, chr(10), ' '), 300) AS short FROM chapters""")
def chapter_preview(spark, d):
    s = X.strip(c("content_text"))
    return t(spark, d, "chapters").select("chapter_id", F.left(s, F.lit(200)).alias("preview"), F.length(s).cast("long").alias("n_chars"), F.left(F.translate("content_text", "\n", " "), F.lit(300)).alias("short"))


@query("""WITH r AS (SELECT book_id, chapter_id, length(coalesce(content_text, ''))::BIGINT AS n_chars, row_number() OVER (PARTITION BY
book_id ORDER BY length(coalesce(content_text, '')), chapter_number, chapter_id) AS k, count(*) OVER (PARTITION BY book_id) AS n FROM
chapters WHERE book_id IS NOT NULL)
SELECT book_id, chapter_id, n_chars FROM r WHERE k = n // 2 + 1""")
def median_chapter(spark, d):
    return C.upper_median(t(spark, d, "chapters"))


@query("SELECT chapter_id, book_id FROM chapters WHERE book_id IN (SELECT id FROM books WHERE visibility = 1)")
def select_chapters(spark, d):
    visible = t(spark, d, "books").where("visibility = 1").select(c("id").alias("book_id"))
    return C.select_or_all(t(spark, d, "chapters").select("chapter_id", "book_id"), visible, "book_id")


@query("SELECT chapter_id, book_id FROM chapters")
def select_without_choice(spark, d):
    """Nothing is chosen, so all chapters stay."""
    none = t(spark, d, "books").where("visibility = 99").select(c("id").alias("book_id"))
    return C.select_or_all(t(spark, d, "chapters").select("chapter_id", "book_id"), none, "book_id")


@query(f"""SELECT chapter_id, book_id FROM chapters c WHERE {strip_sql('content_text')} <> '' AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.book_id
= c.book_id AND x.doc_kind = 'summary')""")
def missing_chapters(spark, d):
    done = t(spark, d, "documents").where("doc_kind = 'summary'").select("book_id")
    filled = t(spark, d, "chapters").where(X.strip(c("content_text")) != "")
    return filled.select("chapter_id", "book_id").join(done, "book_id", "left_anti").select("chapter_id", "book_id")


@query("""SELECT chapter_id, coalesce(c.book_id IN (SELECT book_id FROM documents WHERE book_id IS NOT NULL AND doc_kind = 'show_notes'), false) AS
has_notes FROM chapters c""")
def chapter_flags(spark, d):
    marked = t(spark, d, "documents").where("doc_kind = 'show_notes'").select("book_id").distinct().withColumn("hit", F.lit(True))
    return t(spark, d, "chapters").select("chapter_id", "book_id").join(marked, "book_id", "left").select("chapter_id", F.coalesce("hit", F.lit(False)).alias("has_notes"))


@query(f"""SELECT chapter_id, {slug_sql('chapter_title')} AS slug, format('{{:03d}}_{{}}.mp3', coalesce(chapter_number, 0), {slug_sql('chapter_title')})
AS file, coalesce(chapter_number, 0)::BIGINT AS episode_index, translate({slug_sql('chapter_title')}, '_', ' ') AS episode_title FROM
chapters""")
def chapter_files(spark, d):
    rows = t(spark, d, "chapters").select("chapter_id", X.slugify(c("chapter_title")).alias("slug"), X.chapter_filename(c("chapter_number"), c("chapter_title")).alias("file"))
    e = X.episode_title(c("file"))
    return rows.select("chapter_id", "slug", "file", e["index"].alias("episode_index"), e["title"].alias("episode_title"))


@query("""WITH h AS (SELECT book_id, chapter_id, chapter_number, split_part(href, '#', 1) AS path, nullif(CASE WHEN instr(href, '#') > 0 THEN
substr(href, instr(href, '#') + 1) END, '') AS anchor FROM chapters WHERE book_id IS NOT NULL),
m AS (SELECT *, CASE WHEN lag(path) OVER w IS NOT DISTINCT FROM path THEN 0 ELSE 1 END AS ch FROM h WINDOW w AS (PARTITION BY book_id ORDER
BY chapter_number, chapter_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY book_id ORDER BY chapter_number, chapter_id) AS run FROM m)
SELECT book_id, chapter_id, path, anchor, first_value(anchor IGNORE NULLS) OVER (PARTITION BY book_id, run ORDER BY chapter_number,
chapter_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_anchor FROM r""")
def next_anchors(spark, d):
    return C.next_anchor(t(spark, d, "chapters"))


# --- text ----------------------------------------------------------------------------------------------------------


@query(f"SELECT chapter_id, {strip_sql(f"regexp_replace(content_text, '{BLANK}+', ' ', 'g')")} AS text FROM chapters")
def normalized_text(spark, d):
    return t(spark, d, "chapters").select("chapter_id", X.normalize_ws(c("content_text")).alias("text"))


@query(f"""SELECT doc_id, (pos - 1)::BIGINT AS pos, segment FROM (SELECT doc_id, unnest({segments_sql('text')}) AS segment,
generate_subscripts({segments_sql('text')}, 1) AS pos FROM documents WHERE text IS NOT NULL)""")
def regex_sentences(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(X.segments(c("text"))).alias("pos", "segment")).select("doc_id", c("pos").cast("long").alias("pos"), "segment")


FIRST = rf"""WITH s AS (SELECT doc_id, text, {segments_sql('text')} AS parts FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, text, parts, unnest(parts) AS p, generate_subscripts(parts, 1) AS pos FROM s),
y AS (SELECT doc_id, text, parts, pos, {strip_sql('p')} AS p, sum(length({strip_sql('p')})) OVER (PARTITION BY doc_id ORDER BY pos ROWS
BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
f AS (SELECT doc_id, any_value(text) AS text, any_value(parts) AS parts, max(pos) AS used,
{strip_sql(f"regexp_replace(coalesce(string_agg(p, ' ' ORDER BY pos) FILTER (WHERE p <> ''), ''), '{BLANK}+', ' ', 'g')")} AS first FROM y
WHERE coalesce(before, 0) < 50 GROUP BY doc_id)
"""


@query(FIRST + f"SELECT doc_id, first, CASE WHEN {strip_sql('text')} = '' THEN 0 ELSE used END::BIGINT AS used FROM f")
def first_sentence(spark, d):
    f = X.first_sentence(c("text"))
    return spread(t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", f.alias("f")).select("doc_id", c("f.text").alias("first"), c("f.used").cast("long").alias("used"))


@query(FIRST + f"""SELECT doc_id, CASE WHEN {strip_sql('text')} = '' THEN 'New.' || CASE WHEN len(r) = 0 THEN '' ELSE ' ' ||
array_to_string(r, ' ') END WHEN len(r) = 0 THEN 'New.' ELSE 'New. ' || array_to_string(r, ' ') END AS text
FROM (SELECT doc_id, text, list_filter(list_transform(parts[used + 1:], lambda p: {strip_sql('p')}), lambda p: p <> '') AS r FROM f)""")
def replace_first_sentence(spark, d):
    f = X.first_sentence(c("text"))
    rows = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", f.alias("f"))
    return rows.select("doc_id", X.replace_first_sentence(c("text"), c("f.used"), F.lit("New.")).alias("text"))


@query(f"""SELECT chapter_id, CASE WHEN {strip_sql("coalesce(chapter_title, '')")} = '' THEN content_text ELSE {strip_sql('chapter_title')} || '. ' ||
content_text END AS text FROM chapters""")
def titled_text(spark, d):
    return t(spark, d, "chapters").select("chapter_id", X.prepend_title(c("chapter_title"), c("content_text")).alias("text"))


@query(f"""WITH s AS (SELECT doc_id, text, list_filter(list_transform({segments_sql('text')}, lambda p: {strip_sql('p')}), lambda p: p <> '')
AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(parts) < 2 OR parts[2] = 'Edited.' THEN text ELSE array_to_string(list_transform(parts, lambda p, i: CASE WHEN i
= 2 THEN 'Edited.' ELSE p END), ' ') END AS text FROM s""")
def sentence_edits(spark, d):
    edits = F.create_map(F.lit(2), F.lit("Edited."), F.lit(1), F.lit(" "))
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.apply_edits(c("text"), edits).alias("text"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({strip_sql('text')}, '([.!?]){BLANK}+',
'\\1' || chr(1), 'g'), chr(1)), lambda v: {strip_sql('v')}), lambda v: v <> '') AS parts FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, unnest(parts) AS t, unnest(range(1, len(parts) + 1)) AS k FROM p),
r AS (SELECT doc_id, k, t, length(t) + 1 AS cur, 0 AS grp FROM f WHERE k = 1 UNION ALL
 SELECT f.doc_id, f.k, f.t, CASE WHEN r.cur + length(f.t) + 1 > 1000 THEN length(f.t) ELSE r.cur + length(f.t) + 1 END, CASE WHEN r.cur +
length(f.t) + 1 > 1000 THEN r.grp + 1 ELSE r.grp END FROM r JOIN f ON f.doc_id = r.doc_id AND f.k = r.k + 1),
g AS (SELECT doc_id, grp, string_agg(t, ' ' ORDER BY k) AS x FROM r GROUP BY doc_id, grp),
s AS (SELECT doc_id, grp, i, substr(x, ((i - 1) * 1000 + 1)::BIGINT, 1000) AS chunk FROM (SELECT *, unnest(range(1, (length(x) - 1) // 1000 +
2)) AS i FROM g))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, i) - 1 AS pos, chunk FROM s""")
def pack_sentences(spark, d):
    packed = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.pack_sentences(c("text"), 1000)).alias("pos", "chunk"))
    return packed.select("doc_id", c("pos").cast("long").alias("pos"), "chunk")


@query()
def chunk_text(spark, d):
    limits = spread(t(spark, d, "chapters").where("content_text IS NOT NULL").select("chapter_id", "content_text")).select("chapter_id", F.posexplode(M.chunk_text(500)(c("content_text"))).alias("pos", "chunk"))
    return limits.select("chapter_id", c("pos").cast("long").alias("pos"), "chunk")


@query(r"SELECT chapter_id, regexp_replace(content_text, '\([^)]*\)', '', 'g') AS flat FROM chapters")
def strip_parens(spark, d):
    return t(spark, d, "chapters").select("chapter_id", X.strip_parens_flat(c("content_text")).alias("flat"))


@query("SELECT chapter_id, " + "regexp_replace(" * 8 + "content_text" + r", '\([^()]*\)', '', 'g')" * 8 + " AS deep FROM chapters")
def strip_parens_deep(spark, d):
    return t(spark, d, "chapters").select("chapter_id", X.strip_parens_deep(c("content_text")).alias("deep"))


@query(rf"SELECT chapter_id, regexp_replace(content_text, '\.{BLANK}*(?:\.{BLANK}*)+', '.', 'g') AS text FROM chapters")
def collapse_dots(spark, d):
    return t(spark, d, "chapters").select("chapter_id", X.collapse_dots(c("content_text")).alias("text"))


@query("""SELECT chapter_id, (pos - 1)::BIGINT AS pos, substr(content_text, ((pos - 1) * 500 + 1)::BIGINT, 500) AS piece FROM (SELECT chapter_id,
content_text, unnest(range(1, (length(content_text) - 1) // 500 + 2)) AS pos FROM chapters WHERE length(content_text) > 0)""")
def fixed_slices(spark, d):
    rows = t(spark, d, "chapters").where("length(content_text) > 0").select("chapter_id", F.posexplode(X.fixed_slices(c("content_text"), 500)).alias("pos", "piece"))
    return rows.select("chapter_id", c("pos").cast("long").alias("pos"), "piece")


@query(f"""WITH s AS (SELECT doc_id, {strip_sql('text')} AS s FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, s, length(s) // 2 AS half, CASE WHEN length(s) > 1000 THEN list_filter(list_transform(string_split(s, ''), lambda v, i:
CASE WHEN v IN (',', ';') THEN i - 1 END), lambda i: i IS NOT NULL) ELSE [] END AS marks FROM s),
b AS (SELECT doc_id, s, list_min(list_transform(marks, lambda i: {{'d': abs(i - half), 'i': i}})).i AS best FROM m)
SELECT doc_id, list_filter(CASE WHEN best IS NULL THEN [s] ELSE [{strip_sql('left(s, best + 1)')}, {strip_sql('substr(s, best + 2)')}] END,
lambda v: v <> '') AS parts FROM b""")
def delimiter_split(spark, d):
    return spread(t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", X.split_at_delimiter(c("text"), 1000).alias("parts"))


def _html(spark, d):
    page = F.concat(F.lit("<html><head><style>p { margin: 0 }</style></head><body><h1>"), F.coalesce("chapter_title", F.lit("")), F.lit('</h1><div class="ad">Buy (now)</div><p id="a1">'), F.replace(F.coalesce("content_text", F.lit("")), F.lit("\n\n"), F.lit('</p>\n<p id="a2">')), F.lit("</p><footer>End &amp; out</footer></body></html>"))
    return spread(t(spark, d, "chapters").select("chapter_id", page.alias("html")))


@query()
def page_text(spark, d):
    return _html(spark, d).select("chapter_id", M.strip_html()(c("html")).alias("text"))


@query()
def page_text_without_ads(spark, d):
    return _html(spark, d).select("chapter_id", M.strip_html(("ad",), drop_script=True)(c("html")).alias("text"))


@query()
def page_text_feed(spark, d):
    return _html(spark, d).select("chapter_id", M.strip_html_feed(c("html")).alias("text"))


HTML = """'<html><head><style>p { margin: 0 }</style></head><body><h1>' || coalesce(chapter_title, '') || '</h1><div class="ad">Buy (now)</div><p id="a1">' || replace(coalesce(content_text, ''), chr(10) || chr(10), '</p>' || chr(10) || '<p id="a2">') || '</p><footer>End &amp; out</footer></body></html>'"""


@query(f"""WITH h AS (SELECT chapter_id, {HTML} AS h FROM chapters), s AS (SELECT chapter_id, substr(h, strpos(h, '<p id="a1">')) AS h FROM h)
SELECT chapter_id, CASE WHEN strpos(h, '<p id="a2">') > 0 THEN left(h, strpos(h, '<p id="a2">') - 1) ELSE h END AS part FROM s""")
def anchor_slices(spark, d):
    return _html(spark, d).select("chapter_id", M.slice_by_anchor(c("html"), F.lit("a1"), F.lit("a2")).alias("part"))


@query()
def roman_numerals(spark, d):
    return spread(t(spark, d, "chapters").select("chapter_id", "content_text")).select("chapter_id", M.roman_to_digits(c("content_text")).alias("text"))


# Cleanup rules, as data: fixed examples of what a reader approves.
RULES = (r"\([^)]*\)", r"chapter_\d+\.mp3", r"\bvol\. \d+")


def rules_sql(rules) -> str:
    """Texts after each rule in turn, and what each took away."""
    x, parts = "content_text", []
    for r in rules:
        parts.append(f"list_filter(list_transform(regexp_extract_all({x}, '{r}', 0, 'is'), lambda m: {strip_sql('m')}), lambda m: m <> '')")
        x = f"regexp_replace({x}, '{r}', '', 'gis')"
    joined = parts[0]
    for more in parts[1:]:
        joined = f"list_concat({joined}, {more})"
    return f"SELECT chapter_id, {x} AS text, {joined} AS removed FROM chapters WHERE content_text IS NOT NULL"


@query(rules_sql(RULES))
def apply_rules(spark, d):
    rows = t(spark, d, "chapters").where("content_text IS NOT NULL")
    return C.with_rules(rows, "content_text", RULES).select("chapter_id", c("content_text").alias("text"), "removed")


@query("""SELECT * FROM (VALUES (0, '\\([^)]*\\)', true), (1, '(unclosed', false), (2, '', true), (3, 'a{2,1}', false), (4, NULL, false)) v(rule_no,
rule, valid)""")
def rule_check(spark, d):
    rules = spark.createDataFrame([(0, r"\([^)]*\)"), (1, "(unclosed"), (2, ""), (3, "a{2,1}"), (4, None)], "rule_no int, rule string")
    return C.checked_rules(rules).select("rule_no", "rule", "valid")


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES)) + ") v(rule_no, rule)), m AS (SELECT book_id, rule_no, chapter_number, chapter_id, left(regexp_extract(content_text, rule, 0, 'is'), 300) AS hit FROM chapters, r WHERE book_id IS NOT NULL AND regexp_matches(content_text, rule, 'is')) SELECT book_id, rule_no::BIGINT AS rule_no, (array_agg(hit ORDER BY chapter_number, chapter_id))[1] AS preview FROM m GROUP BY ALL")
def rule_preview(spark, d):
    """First match of each rule in each book; the rules are expressions, so nothing is joined."""
    hits = F.array(*(F.struct(F.lit(i).cast("long").alias("rule_no"), F.left(F.regexp_extract(c("content_text"), "(?is)" + r, 0), F.lit(300)).alias("hit")) for i, r in enumerate(RULES)))
    rows = t(spark, d, "chapters").where("book_id IS NOT NULL").select("book_id", "chapter_number", "chapter_id", F.explode(F.filter(hits, lambda h: h["hit"] != "")).alias("h"))
    return rows.groupBy("book_id", c("h.rule_no").alias("rule_no")).agg(F.min(F.struct("chapter_number", "chapter_id", "h.hit"))["hit"].alias("preview"))


# --- queues --------------------------------------------------------------------------------------------------------

LOG = "(SELECT DISTINCT * FROM player_queue)"
STATE = f"""WITH q AS (SELECT log_id, user_id, pod_id, episode_idx, start_pos, is_current, coalesce(model_name, '') AS model_name,
logged_time FROM {LOG} WHERE user_id IS NOT NULL AND episode_idx IS NOT NULL),
g AS (SELECT user_id, pod_id, episode_idx, min(row(logged_time, log_id)) AS first, (array_agg(row(start_pos, is_current, model_name) ORDER BY
logged_time DESC, log_id DESC))[1] AS last FROM q GROUP BY ALL),
s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first)::BIGINT AS idx, pod_id, episode_idx, last[1] AS start_pos,
last[2] AS is_current, last[3] AS model_name FROM g) """
STATE = STATE.replace("row(start_pos, is_current, model_name)", "{'a': start_pos, 'b': is_current, 'c': model_name}").replace("last[1]", "last.a").replace("last[2]", "last.b").replace("last[3]", "last.c").replace("min(row(logged_time, log_id)) AS first", "min({'t': logged_time, 'i': log_id}) AS first")


def _queue(spark, d):
    return Q.replay(t(spark, d, "player_queue"))


@query(STATE + "SELECT * FROM s")
def player_queue(spark, d):
    return _queue(spark, d)


@query(f"""WITH w AS (SELECT user_id, (array_agg('/pod/' || pod_id ORDER BY logged_time DESC, log_id DESC))[1] AS uri FROM {LOG} WHERE
user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE WHEN w.user_id IS NOT NULL THEN w.uri ELSE l.uri END AS uri FROM last_location l FULL JOIN w USING (user_id)""")
def last_location(spark, d):
    writes = t(spark, d, "player_queue").select("user_id", "logged_time", "log_id", F.concat(F.lit("/pod/"), c("pod_id")).alias("uri"))
    return Q.last_locations(t(spark, d, "last_location"), writes)


@query(f"""WITH q AS (SELECT DISTINCT log_id, user_id, pod_id, episode_idx, logged_time FROM player_queue WHERE user_id IS NOT NULL AND
episode_idx IS NOT NULL)
SELECT log_id, row_number() OVER (PARTITION BY user_id, pod_id, episode_idx ORDER BY logged_time, log_id) = 1 AS inserted FROM q""")
def queue_insertions(spark, d):
    return Q.insertions(t(spark, d, "player_queue"))


@query(STATE + "SELECT user_id, max(idx) + 1 AS next_idx FROM s GROUP BY user_id")
def queue_next_index(spark, d):
    return Q.next_ordinal(_queue(spark, d))


@query(STATE + "SELECT user_id, idx - (idx > 2)::INT AS idx, pod_id, episode_idx FROM s WHERE idx <> 2")
def queue_after_delete(spark, d):
    return Q.delete_at(_queue(spark, d), F.lit(2)).select("user_id", "idx", "pod_id", "episode_idx")


@query(STATE + ", b AS (SELECT *, count(*) FILTER (WHERE idx IN (1, 2)) OVER (PARTITION BY user_id) = 2 AS two FROM s) SELECT user_id, CASE WHEN two AND idx = 1 THEN 2 WHEN two AND idx = 2 THEN 1 ELSE idx END AS idx, pod_id, episode_idx FROM b")
def queue_after_swap(spark, d):
    return Q.swap_at(_queue(spark, d), 1).select("user_id", "idx", "pod_id", "episode_idx")


PREVIOUS = """, p AS (SELECT user_id, max({'t': logged_time, 'i': log_id, 'p': pod_id, 'e': episode_idx}) AS p FROM player_queue WHERE user_id IS NOT NULL AND episode_idx IS NOT NULL AND start_pos > 0 GROUP BY user_id)"""


@query(STATE + PREVIOUS + """SELECT user_id, r.i AS idx, r.p AS pod_id, r.e AS episode_idx FROM (SELECT s.user_id, min({'k': CASE WHEN is_current THEN 0 WHEN p.p.p = pod_id AND p.p.e = episode_idx THEN 1 ELSE 2 END, 'i': idx, 'p': pod_id, 'e': episode_idx}) AS r FROM s LEFT JOIN p USING (user_id) GROUP BY s.user_id)""")
def queue_current_item(spark, d):
    """The previous item is the one whose position was saved last."""
    played = t(spark, d, "player_queue").where("user_id IS NOT NULL AND episode_idx IS NOT NULL AND start_pos > 0")
    previous = played.groupBy("user_id").agg(F.max(F.struct("logged_time", "log_id", "pod_id", "episode_idx")).alias("p")).select("user_id", "p.pod_id", "p.episode_idx")
    return Q.current_item(_queue(spark, d), previous)


@query(STATE + ", n AS (SELECT user_id, count(*) AS n, max((idx = 3)::INT) AS there FROM s GROUP BY user_id) SELECT user_id, idx, CASE WHEN there = 1 THEN idx = 3 WHEN n = 1 THEN true ELSE is_current END AS is_current FROM s JOIN n USING (user_id)")
def queue_set_current(spark, d):
    return Q.set_current(_queue(spark, d), F.lit(3)).select("user_id", "idx", "is_current")


@query(STATE + "SELECT user_id, idx, pod_id, episode_idx FROM s ORDER BY user_id, idx")
def queue_in_order(spark, d):
    return Q.ordered(_queue(spark, d)).select("user_id", "idx", "pod_id", "episode_idx")


EPISODES = """, k AS (SELECT book_id, chapter_number, chapter_id, chapter_title FROM chapters WHERE book_id IS NOT NULL AND chapter_number IS
NOT NULL),
e AS (SELECT 'pod' || book_id AS pod_id, chapter_number AS number, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number) - 1 AS
place, title, dur AS duration
 FROM (SELECT book_id, chapter_number, min({'i': chapter_id, 't': chapter_title}).t AS title, format('{}:{:02d}', max(chapter_id) % 50,
max(chapter_id) % 60) AS dur FROM k GROUP BY ALL)) """


@query(STATE + EPISODES + """SELECT s.user_id, s.idx, coalesce(nullif(CASE WHEN a.pod_id IS NOT NULL THEN a.title ELSE b.title END, ''),
'Episode ' || s.episode_idx) AS title,
 coalesce(nullif(k.book_title, ''), s.pod_id) AS pod_title, coalesce(CASE WHEN a.pod_id IS NOT NULL THEN a.duration ELSE b.duration END,
'--:--') AS duration
FROM s LEFT JOIN books k ON 'pod' || k.id = s.pod_id LEFT JOIN e a ON a.pod_id = s.pod_id AND a.number = s.episode_idx LEFT JOIN e b ON
b.pod_id = s.pod_id AND b.place = s.episode_idx""")
def queue_items(spark, d):
    """Each queued item's episode: a chapter of the pod's book, whose length in the fixture is made from its id."""
    pod = lambda x: F.concat(F.lit("pod"), x.cast("string"))
    pods = t(spark, d, "books").select(pod(c("id")).alias("pod_id"), c("book_title").alias("pod_title"))
    each = t(spark, d, "chapters").where("book_id IS NOT NULL AND chapter_number IS NOT NULL").groupBy("book_id", c("chapter_number").alias("number"))
    each = each.agg(F.min(F.struct("chapter_id", "chapter_title"))["chapter_title"].alias("title"), F.max("chapter_id").alias("last"))
    placed = numbered(each, ["book_id"], F.floor(c("number") / 4096), ["number"], "place")
    length = F.format_string("%d:%02d", c("last") % 50, c("last") % 60)
    episodes = placed.select(pod(c("book_id")).alias("pod_id"), "number", (c("place") - 1).alias("place"), "title", length.alias("duration"))
    return Q.resolve_items(_queue(spark, d), pods, episodes)


@query("""SELECT user_id, book_title, min(id) AS id, max(t) AS modified_time, (array_agg(visibility ORDER BY t DESC, id DESC))[1] AS visibility
FROM (SELECT *, coalesce(modified_time, created_time) AS t FROM books WHERE user_id IS NOT NULL AND book_title IS NOT NULL) GROUP BY user_id,
book_title""")
def upsert_books(spark, d):
    return Q.upsert_books(t(spark, d, "books"))


@query("""SELECT book_title, (array_agg(id ORDER BY (user_id <> (SELECT min(user_id) FROM books))::INT, id))[1] AS id FROM books WHERE book_title IS
NOT NULL AND (user_id = (SELECT min(user_id) FROM books) OR visibility = 1) GROUP BY book_title""")
def preferred_books(spark, d):
    books = t(spark, d, "books")
    return Q.preferred_book(books, books.agg(F.min("user_id").alias("me")))


@query("""SELECT id, user_id, book_title, visibility, coalesce(user_id = (SELECT min(user_id) FROM books), false) AS is_owner FROM books WHERE user_id
= (SELECT min(user_id) FROM books) OR visibility = 1""")
def visible_books(spark, d):
    books = t(spark, d, "books")
    me = c("me")
    return books.crossJoin(F.broadcast(books.agg(F.min("user_id").alias("me")))).where((c("user_id") == me) | (c("visibility") == 1)).select("id", "user_id", "book_title", "visibility", F.coalesce(c("user_id") == me, F.lit(False)).alias("is_owner"))


@query("""SELECT count(*) FILTER (WHERE status IN ('queued', 'paused')) AS waiting, count(*) FILTER (WHERE status = 'running') AS running, count(*)
FILTER (WHERE status IN ('success', 'fail', 'cancelled')) AS done, count(*) AS total FROM jobs""")
def job_status_counts(spark, d):
    s = c("status")
    return t(spark, d, "jobs").agg(F.count_if(s.isin("queued", "paused")).alias("waiting"), F.count_if(s == "running").alias("running"), F.count_if(s.isin("success", "fail", "cancelled")).alias("done"), F.count("*").alias("total"))


@query("""SELECT j.id, coalesce(w.n - 1, -1) AS position FROM jobs j LEFT JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n FROM jobs WHERE status
= 'queued') w USING (id)""")
def queue_position(spark, d):
    """Place in the one waiting list, -1 for jobs that aren't waiting."""
    jobs = t(spark, d, "jobs").select("id", "status")
    placed = numbered(jobs.where("status = 'queued'").select("id"), [], F.substring("id", 1, 11), ["id"], "n")
    return jobs.join(placed, "id", "left").select("id", F.coalesce(c("n") - 1, F.lit(-1)).cast("long").alias("position"))


@query("SELECT id FROM (SELECT id FROM jobs WHERE status <> 'running' AND (SELECT count(*) FROM jobs) > 20 ORDER BY id LIMIT 10)")
def prune_jobs(spark, d):
    """With limits low enough to act on a small table."""
    return Q.prune(t(spark, d, "jobs"), most=20, cut=10)


@query("""WITH e AS (SELECT id, i, p, map_keys(p) AS ks, list_contains(map_keys(p), 'key') AND list_contains(map_keys(p), 'value') AS kv,
len(map_keys(p)) AS n FROM (SELECT id, unnest(params) AS p, generate_subscripts(params, 1) AS i FROM jobs)),
x AS (SELECT id, i, CASE WHEN kv THEN p['key'] ELSE k END AS k, CASE WHEN kv THEN p['value'] ELSE p[k] END AS v, NOT kv AND n > 1 AS weak
FROM (SELECT *, unnest(CASE WHEN kv THEN ['key'] ELSE ks END) AS k FROM e)),
y AS (SELECT *, max(i) FILTER (WHERE NOT weak) OVER (PARTITION BY id, k) AS strong, min(i) OVER (PARTITION BY id, k) AS first FROM x WHERE k <> '')
SELECT id, k AS name, v AS value FROM y WHERE i = coalesce(strong, first)""")
def job_params(spark, d):
    """One row a parameter: key/value entries and one-entry maps, the last of a name; of larger maps the first, where no other names it."""
    return Q.normalised_params(t(spark, d, "jobs"))


@query(f"""SELECT id, greatest(0, least(100, progress))::BIGINT AS progress, lower(trim(command)) AS command,
CASE WHEN lower(trim(command)) IN ('tts', 'generate_feed') THEN 'audio' WHEN lower(trim(command)) = 'parse_epub' THEN 'text' ELSE 'other' END
AS kind, coalesce(lower(trim(progress_msg)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS flag FROM jobs""")
def job_fields(spark, d):
    command = F.lower(F.trim("command"))
    kind = F.when(command.isin("tts", "generate_feed"), "audio").when(command == "parse_epub", "text").otherwise("other")
    return t(spark, d, "jobs").select("id", T.clamp_progress(c("progress")).cast("long").alias("progress"), command.alias("command"), kind.alias("kind"), X.is_true(c("progress_msg")).alias("flag"))


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"


@query(rf"""SELECT id, CASE WHEN regexp_matches(regexp_replace(trim(started_at), '[Zz]$', '+00:00'), '{ISO}') THEN
epoch_us(try_cast(regexp_replace(trim(started_at), '[Zz]$', '+00:00') AS TIMESTAMPTZ)) END AS started_us FROM jobs""")
def job_times(spark, d):
    return t(spark, d, "jobs").select("id", F.unix_micros(T.iso_timestamp(c("started_at"))).alias("started_us"))


# --- timelines -----------------------------------------------------------------------------------------------------

W = """WITH w AS (SELECT id, (pos - 1)::INT AS pos, x->>'word' AS word, (x->>'start')::DOUBLE AS s, (x->>'end')::DOUBLE AS e FROM (SELECT id, unnest(js) AS x, generate_subscripts(js, 1) AS pos FROM (SELECT id, from_json(CASE WHEN json_valid(transcript) THEN transcript END, '["JSON"]') AS js FROM clips WHERE transcript IS NOT NULL))) """


def _words(spark, d):
    return L.timed_words(t(spark, d, "clips"))


W0 = W + """, c AS (SELECT id, start_timestamp AS t0, end_timestamp - start_timestamp AS total FROM clips WHERE end_timestamp > start_timestamp),
o AS (SELECT w.id, pos, s - t0 AS s, e - t0 AS e FROM w JOIN c USING (id) WHERE s IS NOT NULL AND e IS NOT NULL),
g AS (SELECT id, lag(e, 1, 0.0) OVER (PARTITION BY id ORDER BY pos) AS a, s AS b FROM o),
gaps AS (SELECT id, a AS start, b AS "end" FROM g WHERE b > a + 0.001 UNION ALL
 SELECT id, coalesce(l, 0), total FROM c LEFT JOIN (SELECT id, arg_max(e, pos) AS l FROM o GROUP BY id) USING (id) WHERE coalesce(l, 0) <
total - 0.001)"""


def _recorded(spark, d):
    """(words with times from the beginning of their clip, totals) of the clips that have a length."""
    clips = t(spark, d, "clips").where("end_timestamp > start_timestamp").select("id", c("start_timestamp").alias("t0"), (c("end_timestamp") - c("start_timestamp")).alias("total"))
    words = _words(spark, d).join(clips.select("id", "t0"), "id").withColumn("start", c("start") - c("t0")).withColumn("end", c("end") - c("t0"))
    return words, clips.select("id", "total")


@query(W0 + 'SELECT id, round(start, 3) AS start, round("end", 3) AS "end" FROM gaps')
def gap_complement(spark, d):
    gaps = L.speech_gaps(*_recorded(spark, d))
    return gaps.select("id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(W0 + """SELECT c.id, round(coalesce(p.speech, 0), 3) AS speech, round(coalesce(q.silence, 0), 3) AS silence, round(100 *
coalesce(p.speech, 0) / total, 1) AS speech_pct, round(100 * coalesce(q.silence, 0) / total, 1) AS silence_pct,
 round(1 - coalesce(p.speech, 0) / total, 3) AS silent_part FROM c LEFT JOIN (SELECT id, sum(e - s) AS speech FROM o GROUP BY id) p USING
(id) LEFT JOIN (SELECT id, sum("end" - start) AS silence FROM gaps GROUP BY id) q USING (id)""")
def speech_totals(spark, d):
    words, totals = _recorded(spark, d)
    return L.speech_totals(words, totals)


@query(W + """, r AS (SELECT *, regexp_matches(word, '[.?!;]+$')::INT AS is_end, lead(s) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM w
WHERE word IS NOT NULL),
k AS (SELECT *, coalesce(sum(is_end) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM r),
g AS (SELECT id, sentence::BIGINT AS sentence, string_agg(word, ' ' ORDER BY pos) AS text, min({'p': pos, 't': s}).t AS start,
max({'p': pos, 't': coalesce(nxt - 0.02, e), 'x': is_end}) AS last FROM k GROUP BY id, k.sentence)
SELECT id, sentence, text, round(start, 3) AS start, round(last.t, 3) AS "end" FROM g WHERE last.x = 1 AND last.t - start BETWEEN 6.0 AND 15.0""")
def utterances_a(spark, d):
    out = L.sentence_clips(_words(spark, d))
    return out.select("id", c("sentence").cast("long").alias("sentence"), "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(W + """, r AS (SELECT *, regexp_matches(word, '[.?!;]+$')::INT AS is_end, lead(s) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM w
WHERE word IS NOT NULL),
k AS (SELECT *, coalesce(sum(is_end) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM r),
g AS (SELECT id, sentence::BIGINT AS sentence, min({'p': pos, 't': s}).t AS start, max({'p': pos, 't': coalesce(nxt - 0.02, e), 'x': is_end})
AS last FROM k GROUP BY id, k.sentence),
u AS (SELECT c.user_id, g.id, sentence, start, last.t AS e FROM g JOIN clips c ON c.id = g.id WHERE last.x = 1 AND last.t - start BETWEEN 6.0
AND 15.0),
b AS (SELECT *, coalesce(sum(round((e - start + 0.4) * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY id, sentence ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT user_id, id, sentence, round(start, 3) AS start, round(e, 3) AS "end" FROM b WHERE before < 1800000""")
def utterances_within_budget(spark, d):
    clips = L.sentence_clips(_words(spark, d)).join(t(spark, d, "clips").select("id", "user_id"), "id")
    return L.within_budget(clips, "user_id", F.floor(c("id") / 4096), ["id", "sentence"], 0.4, 1800.0).select("user_id", "id", c("sentence").cast("long").alias("sentence"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


SEGMENTS = W.replace("WITH w AS", "WITH RECURSIVE w AS") + """, f AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS k,
coalesce(s, 0) AS a, coalesce(e, 0) AS b, coalesce(word, '') AS t, coalesce(e, 0) - coalesce(s, 0) AS n FROM w WHERE coalesce(e, 0) -
coalesce(s, 0) > 0),
r AS (SELECT id, k, a, b, t, CASE WHEN n > 15 THEN 0 ELSE n END AS cur, 0 AS grp, n <= 15 AS kept FROM f WHERE k = 1
 UNION ALL SELECT f.id, f.k, f.a, f.b, f.t, CASE WHEN f.n > 15 THEN 0 WHEN r.cur + f.n > 10 AND r.cur >= 8 THEN f.n ELSE r.cur + f.n END,
  CASE WHEN f.n > 15 OR r.cur + f.n > 10 AND r.cur >= 8 THEN r.grp + 1 ELSE r.grp END, f.n <= 15 FROM r JOIN f ON f.id = r.id AND f.k = r.k + 1),
u AS (SELECT id, grp, arg_min(a, k) AS a, arg_max(b, k) AS b, string_agg(trim(t), ' ' ORDER BY k) AS text, arg_max(cur, k) AS total FROM r
WHERE kept GROUP BY id, grp),
v AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY grp) - 1)::INT AS utterance, a AS start, b AS "end", text FROM u WHERE total
BETWEEN 1 AND 15) """


@query(SEGMENTS + "SELECT * FROM v")
def utterances_b(spark, d):
    return L.segment_groups(_words(spark, d))


@query(SEGMENTS + """, x AS (SELECT c.user_id, v.*, coalesce(sum(round(("end" - start) * 1000)::BIGINT) OVER (PARTITION BY c.user_id ORDER BY
v.id, utterance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v JOIN clips c ON c.id = v.id)
SELECT user_id, id, utterance FROM x WHERE before < 60000""")
def utterances_b_within_budget(spark, d):
    """The first minute of each user's utterances; a run ends with the one that reaches it."""
    groups = L.segment_groups(_words(spark, d)).join(t(spark, d, "clips").select("id", "user_id"), "id")
    return L.within_budget(groups, "user_id", F.floor(c("id") / 4096), ["id", "utterance"], 0.0, 60.0).select("user_id", "id", "utterance")


PACKED = W.replace("WITH w AS", "WITH RECURSIVE w AS") + """, f AS (SELECT id, pos AS k, coalesce(word, '') AS t, length(coalesce(word, ''))
+ 1 AS n, s FROM w),
r AS (SELECT id, k, t, n AS cur, 0 AS line, s FROM f WHERE k = 0 UNION ALL
 SELECT f.id, f.k, f.t, CASE WHEN r.cur + f.n > 30 THEN f.n ELSE r.cur + f.n END, CASE WHEN r.cur + f.n > 30 THEN r.line + 1 ELSE r.line END,
f.s FROM r JOIN f ON f.id = r.id AND f.k = r.k + 1) """


@query(PACKED + "SELECT id, list(words ORDER BY line) AS lines FROM (SELECT id, line, list(t ORDER BY k) AS words FROM r GROUP BY id, line) GROUP BY id")
def line_packing(spark, d):
    words = F.transform(F.from_json("transcript", L.WORDS), lambda w: F.coalesce(w["word"], F.lit("")))
    return t(spark, d, "clips").select("id", words.alias("w")).where(F.size("w") > 0).select("id", X.pack_lines(c("w")).alias("lines"))


LENGTHS = "SELECT id, start_timestamp AS t0, end_timestamp - start_timestamp AS total FROM clips WHERE end_timestamp - start_timestamp > 0 AND end_timestamp - start_timestamp <= 60"


@query(W + f""", f AS (SELECT id, t0 + frame AS moment, frame::INT AS frame FROM (SELECT *, unnest(range(0, floor(total)::BIGINT)) AS frame
FROM ({LENGTHS}) WHERE total >= 1))
SELECT f.id, frame, pos, CASE WHEN moment >= e THEN 'spoken' WHEN moment >= s THEN 'current' ELSE 'pending' END AS state FROM f JOIN w ON
w.id = f.id""")
def word_states(spark, d):
    length = c("end_timestamp") - c("start_timestamp")
    clips = t(spark, d, "clips").where((length > 0) & (length <= 60)).select("id", c("start_timestamp").alias("start"), length.alias("length"))
    return L.word_states(L.frames(clips, 1), _words(spark, d).select("id", "pos", "start", "end"))


@query(W + "SELECT id, pos, round_even(coalesce(s, 0) + 12.5, 3) AS start FROM w")
def word_offsets(spark, d):
    return _words(spark, d).select("id", "pos", T.word_offset(c("start"), F.lit(12.5)).alias("start"))


@query(PACKED + f""", z AS (SELECT id, max(line) + 1 AS n_lines, count(*) FILTER (WHERE line < 1) AS upto FROM r GROUP BY id),
d AS (SELECT z.id, n_lines, r.s AS due FROM z LEFT JOIN r ON r.id = z.id AND r.k = z.upto),
m AS (SELECT c.*, n_lines, CASE WHEN n_lines > 2 THEN coalesce(due, t0) - t0 ELSE 0.0 END AS trigger FROM ({LENGTHS}) c JOIN d USING (id)),
y AS (SELECT *, unnest(range(0, floor(total * 4)::BIGINT)) AS frame FROM m WHERE floor(total * 4) >= 1)
SELECT id, frame, CASE WHEN n_lines > 2 AND frame / 4 > trigger THEN floor(least(1.0, greatest(0.0, (frame / 4 - trigger) / CASE WHEN trigger
< total THEN total - trigger ELSE 1.0 END)) * (n_lines - 2) * 36) ELSE 0 END::BIGINT AS offset_px FROM y""")
def scroll_offsets(spark, d):
    """With two visible lines, since the fixture's clips have few."""
    length = c("end_timestamp") - c("start_timestamp")
    clips = t(spark, d, "clips").where((length > 0) & (length <= 60)).select("id", c("start_timestamp").alias("start"), length.alias("length"), F.from_json("transcript", L.WORDS).alias("words")).where(F.size("words") > 0)
    return L.scroll_offsets(clips, visible=2).select("id", c("frame").cast("long").alias("frame"), "offset_px")


@query("""WITH k AS (SELECT user_id AS chunk_idx, (event_id // 2 % 7 + 1)::INT AS attempt, (event_id % 2)::INT AS copy, round(value / 200, 6)
AS silence FROM events WHERE value IS NOT NULL),
u AS (SELECT chunk_idx, attempt, copy, min(silence) AS silence FROM k GROUP BY ALL)
SELECT chunk_idx, coalesce(a.attempt, l.attempt) AS attempt, coalesce(a.copy, l.copy) AS copy, coalesce(a.silence, l.silence) AS silence, a
IS NOT NULL AS accepted FROM (
SELECT chunk_idx, min({'attempt': attempt, 'copy': copy, 'silence': silence}) FILTER (WHERE silence <= 0.1) AS a,
min({'s': silence, 'attempt': attempt, 'copy': copy, 'silence': silence}) AS l FROM u WHERE attempt <= 5 GROUP BY chunk_idx)""")
def best_candidate(spark, d):
    rows = t(spark, d, "events").where("value IS NOT NULL").select(c("user_id").alias("chunk_idx"), (F.floor(c("event_id") / 2) % 7 + 1).cast("int").alias("attempt"), (c("event_id") % 2).cast("int").alias("copy"), F.round(c("value") / 200, 6).alias("silence"))
    return L.best_candidates(rows.groupBy("chunk_idx", "attempt", "copy").agg(F.min("silence").alias("silence")))


@query(rf"""WITH w AS (SELECT c.id, c.user_id, c.end_timestamp - c.start_timestamp AS secs,
list_filter(string_split_regex(lower(coalesce(array_to_string(list_transform(from_json(CASE WHEN json_valid(transcript) THEN transcript END,
'["JSON"]'), lambda x: x->>'word'), ' '), '')), ' '), lambda v: v <> '') AS words FROM clips c)
SELECT user_id, round(sum(secs), 3) AS seconds, sum(len(words))::BIGINT AS n_words, sum(list_sum(list_transform(words, lambda v:
greatest(len(regexp_extract_all(v, '[aeiouy]+')), 1))))::BIGINT AS n_syllables, round(sum(len(words)) / nullif(sum(secs) / 60, 0), 3) AS
words_per_min FROM w WHERE secs > 0 AND user_id IS NOT NULL GROUP BY user_id""")
def speaking_rate(spark, d):
    words = F.filter(F.split(F.lower(F.coalesce(F.array_join(F.transform(F.from_json("transcript", L.WORDS), lambda w: w["word"]), " "), F.lit(""))), " "), lambda v: v != "")
    n_syl = F.aggregate(F.transform(words, X.syllables), F.lit(0), lambda a, v: a + v)
    rows = t(spark, d, "clips").where("user_id IS NOT NULL").select("user_id", (c("end_timestamp") - c("start_timestamp")).alias("secs"), F.size(words).alias("n"), n_syl.alias("syl")).where("secs > 0")
    return rows.groupBy("user_id").agg(F.round(F.sum("secs"), 3).alias("seconds"), F.sum("n").alias("n_words"), F.when(F.sum("n") > 0, F.sum("syl")).cast("long").alias("n_syllables"), F.round(F.try_divide(F.sum("n"), F.sum("secs") / 60), 3).alias("words_per_min"))


@query("SELECT id, end_timestamp - start_timestamp > 0 AND end_timestamp - start_timestamp <= 60 AND end_timestamp <= 86400 AS valid FROM clips")
def clip_validity(spark, d):
    n = c("end_timestamp") - c("start_timestamp")
    return t(spark, d, "clips").select("id", ((n > 0) & (n <= 60) & (c("end_timestamp") <= 86400)).alias("valid"))


# --- dates, durations, numbers -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate + to_days((o_orderkey % 30)::INT), '%a, %d %b %Y %H:%M:%S +0000') AS pub_date FROM orders")
def publication_dates(spark, d):
    moved = c("o_orderdate") + F.make_dt_interval((c("o_orderkey") % 30).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", T.rfc822(moved).alias("pub_date"))


@query("""WITH v AS (SELECT event_id, value * 100 AS x, round_even(value * 100, 0)::BIGINT AS r, floor(value * 100)::BIGINT AS f FROM events
WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN r >= 3600 THEN format('{}:{:02d}:{:02d}', r // 3600, r % 3600 // 60, r % 60) ELSE format('{:02d}:{:02d}', r // 60,
r % 60) END AS feed,
CASE WHEN f >= 3600 THEN format('{}:{:02d}:{:02d}', f // 3600, f % 3600 // 60, f % 60) ELSE format('{}:{:02d}', f // 60, f % 60) END AS list,
CASE WHEN x < 0 THEN '0:00' ELSE format('{}:{:02d}', f // 60, f % 60) END AS clock,
CASE WHEN x < 0 THEN '—' WHEN f >= 3600 THEN format('~{}h {}m', f // 3600, f % 3600 // 60) WHEN f >= 60 THEN format('~{}m {}s', f // 60, f %
60) ELSE format('~{}s', f) END AS eta, f::DOUBLE AS parsed FROM v""")
def durations(spark, d):
    x = c("value") * 100
    rows = t(spark, d, "events").where("value IS NOT NULL").select("event_id", T.duration_feed(x).alias("feed"), T.duration_list(x).alias("list"), T.clock(x).alias("clock"), T.eta(x).alias("eta"))
    return rows.withColumn("parsed", T.parse_duration(c("list")))


@query("""SELECT event_id, round_even((event_id % 17 + 1) / 17 * 100, 0)::INT AS pct, floor((value / ((event_id % 99 + 1) / 100::DOUBLE) - value) *
100)::BIGINT AS eta_cs, (greatest(0, least(100, (value * 3)::INT)))::INT AS clamped FROM events WHERE value IS NOT NULL""")
def tts_progress(spark, d):
    done = (c("event_id") % 99 + 1) / 100.0
    return t(spark, d, "events").where("value IS NOT NULL").select("event_id", T.stage_percent(c("event_id") % 17 + 1, F.lit(17)).alias("pct"), F.floor((c("value") / done - c("value")) * 100).cast("long").alias("eta_cs"), T.clamp_progress(F.bround(c("value") * 3)).alias("clamped"))


@query("""WITH s AS (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 50 + 1)::DOUBLE AS h FROM part),
n AS (SELECT p_partkey, CASE WHEN w / h > 406 / 720::DOUBLE THEN floor(720 * (w / h)) ELSE 406 END::BIGINT AS new_width, CASE WHEN w / h >
406 / 720::DOUBLE THEN 720 ELSE floor(406 / (w / h)) END::BIGINT AS new_height FROM s)
SELECT *, (new_width - 406) // 2 AS left_px, (new_height - 720) // 2 AS top_px FROM n""")
def cover_geometry(spark, d):
    g = T.fill_frame(c("p_size").cast("double"), (c("p_partkey") % 50 + 1).cast("double"), 406, 720)
    return t(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", *(c(f"g.{n}").alias(n) for n in ("new_width", "new_height", "left_px", "top_px")))


@query(r"""SELECT p_partkey, replace(replace(regexp_extract(p_name, '([^/]*)$', 1), ' ', ''), '\', '') AS pod, regexp_replace(regexp_replace(p_name, '\.[^.]+$', ''), '\s', '', 'g') AS name, regexp_replace(lower(trim(p_brand)), '-tts$', '') AS model FROM part""")
def sanitize_titles(spark, d):
    return t(spark, d, "part").select("p_partkey", X.sanitize_title(c("p_name")).alias("pod"), X.sanitize_name(c("p_name")).alias("name"), X.strip_suffix(c("p_brand")).alias("model"))


@query("SELECT id, replace(url_encode(video_url), '%2F', '/') AS u FROM clips WHERE video_url IS NOT NULL")
def quoted_urls(spark, d):
    return t(spark, d, "clips").where("video_url IS NOT NULL").select("id", X.quote_path(c("video_url")).alias("u"))


@query("""WITH k AS (SELECT id, title, CASE WHEN title = '' THEN 0 ELSE coalesce(try_cast(title AS BIGINT), 9007199254740991) END AS sort_key
FROM (SELECT id, trim(CASE WHEN id % 7 = 0 THEN 'x' ELSE coalesce(regexp_extract(book_title, '([0-9]+)$', 1), '') END) AS title FROM books))
SELECT *, row_number() OVER (ORDER BY sort_key, id) AS place FROM k ORDER BY place""")
def sort_indices(spark, d):
    """Books by the number at the end of their title; every seventh has a sign that is none."""
    title = F.when(c("id") % 7 == 0, F.lit("x")).otherwise(F.coalesce(F.regexp_extract("book_title", "([0-9]+)$", 1), F.lit("")))
    rows = t(spark, d, "books").select("id", title.alias("title")).withColumn("sort_key", X.numeric_key(c("title")))
    return numbered(rows, [], F.least(F.floor(c("sort_key") / 64), F.lit(1 << 20)), ["sort_key", "id"], "place").orderBy("place")


@query("""SELECT (array_agg(model_name ORDER BY log_id))[1] AS model_name, count(*) AS n FROM player_queue WHERE model_name IS NOT NULL AND
trim(model_name) <> '' GROUP BY lower(trim(model_name))""")
def dedupe_names(spark, d):
    rows = t(spark, d, "player_queue").where("model_name IS NOT NULL AND trim(model_name) <> ''")
    return rows.groupBy(F.lower(F.trim("model_name")).alias("k")).agg(F.min(F.struct("log_id", "model_name"))["model_name"].alias("model_name"), F.count("*").alias("n")).drop("k")


@query("""SELECT user_id, list(k ORDER BY first) AS ids FROM (SELECT user_id, event_id % 20 AS k, min(ts) AS at, min({'t': ts, 'i': event_id}) AS first
FROM events GROUP BY ALL) GROUP BY user_id""")
def dedupe_ids(spark, d):
    """The distinct ids of each user in the order of their first event."""
    first = t(spark, d, "events").groupBy("user_id", (c("event_id") % 20).alias("k")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "k"))), lambda x: x["k"]).alias("ids"))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id,
e.vec_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS x FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS r FROM s) SELECT query_id, vec_id, round(x, 6) AS score
FROM r WHERE r <= 5""")
def speaker_similarity(spark, d):
    v = t(spark, d, "embeddings")
    return top_similar(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, len(t)::INT AS n_kept, round(list_sum(list_transform(embedding, lambda v: greatest(-0.1, least(0.1, v))))::DOUBLE, 4) AS clipped FROM (SELECT vec_id, embedding, CASE WHEN len(list_filter(embedding, lambda v: abs(v) > 0.01)) = 0 THEN embedding ELSE embedding[list_position(list_transform(embedding, lambda v: abs(v) > 0.01), true):len(embedding) - list_position(list_reverse(list_transform(embedding, lambda v: abs(v) > 0.01)), true) + 1] END AS t FROM embeddings)""")
def sample_arrays(spark, d):
    total = F.aggregate(F.transform("embedding", lambda v: F.greatest(F.lit(-0.1), F.least(F.lit(0.1), v.cast("double")))), F.lit(0.0), lambda a, v: a + v)
    return t(spark, d, "embeddings").select("vec_id", F.size(T.trim_silence(c("embedding"))).alias("n_kept"), F.round(total, 4).alias("clipped"))


# --- extensions over the star tables -------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def ext_grouping_sets(spark, d):
    rows = t(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def ext_hourly_events(spark, d):
    return t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


from foliant.plans import records  # noqa: E402, F401  (registers its queries)
