"""Rules of headers, policies, stand-ins and messages over whole tables, as columns and joins, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers
from ..operators import audit, bench, classify, leakscan, mask, restore
from ..sources import rows as R
from .privacy_queries import _FOLDED, _WORDS, _tokens, _words, read

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


# ---------------------------------------------------------------- headers

_URL_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([^\\P{L}\\p{Lu}])(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '(\\p{N})(\\p{L})', '\\1 \\2', 'g'), '(\\p{L})(\\p{N})', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("p9_words_of_urls", f"SELECT page_id, array_to_string({_URL_WORDS}, '|') AS words FROM pages")
def _p9(s, d):
    """Words of addresses by the rules of headers."""
    return read(s, d, "pages").select("page_id", F.array_join(headers.words(F.col("url")), "|").alias("words"))


#: All words that headers are known by, which the catalogue's headers take in turn, two each.
_KNOWN = sorted({w for ws in classify.KIND_WORDS.values() for w in ws} | set(classify.PRIVATE_WORDS) | set(classify.TOGETHER))
_KNOWN = [w for w in _KNOWN if w.isalpha()] + ["plate", "gizmo", "total"]


def _catalogue(s, d):
    """A catalogue of columns, one a part: its header is of one or two known words, joined in three styles."""
    k, known = F.col("p_partkey"), F.array(*map(F.lit, _KNOWN))
    n = len(_KNOWN)
    a, b = F.get(known, (k % n).cast("int")), F.get(known, (F.floor(k / 7) % n).cast("int"))
    header = F.when(k % 4 == 0, F.initcap(a)).when(k % 4 == 1, F.concat(F.initcap(a), F.initcap(b))).when(k % 4 == 2, F.concat(F.upper(a), F.lit("_"), b)).otherwise(F.concat(a, F.lit(" ("), F.initcap(b), F.lit(")")))
    share = F.when(k % 5 == 0, 0.75).otherwise(0.25)
    kind = F.when(k % 2 == 0, "text").otherwise("number")
    return read(s, d, "part").select("p_partkey", F.col("p_brand").alias("letter"), header.alias("header"), kind.alias("type"), share.alias("id_share"), F.when(k % 11 == 0, 0.75).otherwise(0.0).alias("email_share"))


_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_CATALOGUE = f"SELECT *, CASE WHEN k % 4 = 0 THEN [a] ELSE [a, b] END AS w FROM (SELECT p_partkey AS k, p_brand, {_list(_KNOWN)}[p_partkey % {len(_KNOWN)} + 1] AS a, {_list(_KNOWN)}[(p_partkey // 7) % {len(_KNOWN)} + 1] AS b FROM part)"
_has = lambda kind: f"list_has_any(w, {_list(classify.KIND_WORDS[kind])})"


@query("t3_kinds_of_headers", f"SELECT k AS p_partkey, CASE WHEN {_has('email')} OR k % 11 = 0 THEN 'EMAIL' WHEN {_has('strong id')} THEN 'ID' WHEN {_has('name')} AND NOT {_has('thing')} THEN 'PERSON' WHEN {_has('weak id')} THEN 'ID' WHEN {_has('person')} OR k % 4 = 0 AND {_has('alone')} THEN 'PERSON' WHEN k % 5 = 0 AND k % 2 = 0 THEN 'ID' ELSE 'TEXT' END AS kind FROM ({_CATALOGUE})")
def _t3(s, d):
    return classify.described(_catalogue(s, d)).select("p_partkey", "kind")


_TOGETHER = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in classify.TOGETHER.items()) + "}"


@query("p10_keywords_of_headers", f"WITH x AS (SELECT k, list_filter(list_transform(w, lambda x: CASE WHEN list_contains({_list(w for w in classify.PRIVATE_WORDS if w.isalpha())}, x) THEN x ELSE {_TOGETHER}[x] END), lambda x: x IS NOT NULL) AS s FROM ({_CATALOGUE})) SELECT k AS p_partkey, CASE WHEN len(s) = 2 AND s[1] <> s[2] THEN s[1] || '|' || s[2] ELSE coalesce(s[1], '') END AS keywords FROM x")
def _p10(s, d):
    return classify.described(_catalogue(s, d)).select("p_partkey", F.array_join("keywords", "|").alias("keywords"))


@query("p18_aliases_of_headers", f"SELECT k AS p_partkey, CASE WHEN list_has_any(w, {_list(classify.REVEALING_WORDS)}) THEN 'Field ' || p_brand END AS alias FROM ({_CATALOGUE})")
def _p18(s, d):
    return classify.described(_catalogue(s, d)).select("p_partkey", "alias")


@query("p20_texts_that_reveal_languages", f"SELECT doc_id, coalesce(regexp_matches({_FOLDED}, '(^|[^\\p{{L}}\\p{{N}}])' || lang || '($|[^\\p{{L}}\\p{{N}}])'), FALSE) AS reveals, FALSE AS inside FROM documents")
def _p20(s, d):
    """Whether an alias (a whole text) reveals a header (a language's code); as a part of a word it doesn't."""
    lang = F.col("lang")
    return read(s, d, "documents").select("doc_id", headers.reveals(F.col("text"), lang).alias("reveals"), headers.reveals(F.concat(F.lit("x"), lang), lang).alias("inside"))


# ---------------------------------------------------------------- policies


def _choices(s, d):
    """Two states of a catalogue of columns, one a customer: every third header changes, every seventh has no choice."""
    c, k = read(s, d, "customer"), F.col("c_custkey")
    of = c.select(k.alias("k"), F.col("c_mktsegment").alias("sheet"), k.cast("string").alias("letter"), F.when(k % 5 > 0, F.col("c_name")).alias("header"), F.lit("text").alias("type"))
    treatments = F.array(*map(F.lit, ("as_is", "exclude", "range", "month", "stand_in")))
    old = of.where("k % 7 <> 0").select("sheet", "letter", F.when(F.col("k") % 3 == 0, F.concat("header", F.lit("!"))).otherwise(F.col("header")).alias("header"), "type", (F.col("k") % 2 == 0).alias("private"), F.get(treatments, (F.floor(F.col("k") / 2) % 5).cast("int")).alias("treatment"))
    return of, old


_CHOICE = "SELECT c_custkey AS k, (c_custkey % 7 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 5 = 0)) AS same, c_custkey % 2 = 0 AS was, ['as_is', 'exclude', 'range', 'month', 'stand_in'][(c_custkey // 2) % 5 + 1] AS t FROM customer"


@query("p19_policies_after_a_refresh", f"SELECT k, NOT same OR was AS private FROM ({_CHOICE})")
def _p19(s, d):
    return classify.refreshed(*_choices(s, d)).select("k", "private")


@query("p21_treatments_after_a_refresh", f"SELECT k, CASE WHEN NOT same THEN 'stand_in' WHEN was THEN CASE t WHEN 'as_is' THEN 'stand_in' ELSE t END ELSE CASE t WHEN 'exclude' THEN t ELSE 'as_is' END END AS treatment FROM ({_CHOICE})")
def _p21(s, d):
    return classify.refreshed(*_choices(s, d)).select("k", "treatment")


# ---------------------------------------------------------------- stand-ins back to values

_TOKEN_SQL = "SELECT c_name AS value, CASE WHEN n < 1000 THEN printf('%03d', n) ELSE CAST(n AS VARCHAR) END AS no FROM (SELECT c_name, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM customer GROUP BY c_name)"


def _customers_of_orders(s, d, **kw):
    """Orders with the stand-in of their customer's name."""
    names = read(s, d, "customer").select("c_custkey", "c_name")
    tokens = _tokens(s, d, **kw)
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return o.join(names, F.col("o_custkey") == F.col("c_custkey")).join(tokens.select(F.col("value").alias("c_name"), "token"), "c_name"), tokens


_OF_ORDERS = f"SELECT o_orderkey, c_name, no, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({_TOKEN_SQL}) ON value = c_name"


@query("t24_restore_formulas", f"SELECT o_orderkey, '=COUNTIF(A:A,\"' || c_name || ' \"\"' || o_orderpriority || '\"\" EMAIL_000\")+PERSON_' || no || '+''PERSON_' || no || '''!A1' AS formula, 'EMAIL_000|PERSON_' || no AS unknown FROM ({_OF_ORDERS})")
def _t24(s, d):
    """Tokens inside literals become values, outside they are unknown, in a sheet's name they are neither."""
    o, tokens = _customers_of_orders(s, d)
    formula = F.concat(F.lit('=COUNTIF(A:A,"'), "token", F.lit(' ""'), "o_orderpriority", F.lit('"" EMAIL_000")+'), "token", F.lit("+'"), "token", F.lit("'!A1"))
    out = restore.restore_formulas(o.select("o_orderkey", formula.alias("formula")), "formula", tokens)
    return out.select("o_orderkey", "formula", F.array_join("unknown", "|").alias("unknown"))


@query("t26_prefixed_tokens", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ID_007' END ELSE c_name END AS value FROM ({_OF_ORDERS})")
def _t26(s, d):
    """Tokens with their prefix, the same without it, and others, of which one is a text of the sheet."""
    o, tokens = _customers_of_orders(s, d)
    longer = tokens.select("value", F.concat(F.lit("DEID_"), "token").alias("token"))
    k = F.col("o_orderkey")
    asked = o.select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("DEID_"), "token")).when(k % 3 == 1, F.col("token")).when(k % 2 == 0, "ID_007").otherwise("ID_008").alias("token"))
    return restore.resolved(asked, longer, "DEID_", ("ID_007",)).select("o_orderkey", "value")


@query("t28_segments_of_texts", f"WITH o AS ({_OF_ORDERS}) SELECT o_orderkey, 0 AS n, 'PERSON_' || no AS segment, TRUE AS is_token FROM o UNION ALL SELECT o_orderkey, 1, ' has ' || o_orderpriority || ', not XPERSON_1 ', FALSE FROM o UNION ALL SELECT o_orderkey, 2, 'PERSON_' || no, TRUE FROM o UNION ALL SELECT o_orderkey, 3, '.', FALSE FROM o")
def _t28(s, d):
    o, _ = _customers_of_orders(s, d)
    texts = o.select("o_orderkey", F.concat("token", F.lit(" has "), "o_orderpriority", F.lit(", not XPERSON_1 "), "token", F.lit(".")).alias("text"))
    return restore.text_segments(texts, "text")


# ---------------------------------------------------------------- messages

#: Names of documents that are broadcast at most (some 50 bytes each).
NEAR_NAMES = 1_000_000
_BODIES = f"SELECT doc_id, concat_ws(' ', {_FOLDED}, lower(c_name)) AS t FROM documents LEFT JOIN customer ON doc_id = c_custkey * 10"


@query("a21_messages_of_documents", f"WITH b AS MATERIALIZED ({_BODIES}), w AS MATERIALIZED (SELECT lower(w) AS w FROM ({_WORDS}) WHERE w ~ '^[A-Z]'), f AS (SELECT doc_id, 'C' AS c FROM b JOIN customer ON contains(t, lower(c_name)) UNION SELECT doc_id, 'W' FROM b JOIN w ON contains(t, w)) SELECT doc_id, 'private values of column' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' ' || string_agg(c, ', ' ORDER BY c) || ' are in the text' AS message FROM f GROUP BY doc_id")
def _a21(s, d):
    """What is said of every document that names a customer or holds a capitalised word that mustn't go out."""
    c = read(s, d, "customer")
    cells = c.select(F.lit("C").alias("column"), F.col("c_name").alias("value")).union(_words(s, d).where("value rlike '^[A-Z]'").select(F.lit("W"), "value"))
    named = c.select((F.col("c_custkey") * 10).alias("k"), "c_name")
    docs = read(s, d, "documents")
    named = R.written(named.join(docs.select(F.col("doc_id").alias("k")), "k", "left_semi"), "named")
    if named.count() <= NEAR_NAMES:  # whole texts stay where they are
        named = F.broadcast(named)
    bodies = docs.join(named, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.concat_ws(" ", "text", "c_name").alias("body"))
    found = audit.scan(bodies, audit.dictionary(cells), key="doc_id", text="body").where("kind = 'exact'")
    return audit.messages(found, "doc_id")


@query("b7_planted_leaks", "SELECT 'raw' AS mode, c_custkey AS body_id, 'Zq' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 10) AS id FROM customer")
def _b7(s, d):
    """Canaries in every row: rows that go out as they are leak theirs, and masked ones none."""
    c, canaries = bench.planted(read(s, d, "customer"), "c_name", 1, "c_custkey")
    policies = [classify.Policy(letter, letter in "BD", {"B": "stand_in", "D": "range"}.get(letter, "as_is")) for letter in "ABCDE"]
    masked, _ = mask.mask(c, policies, {"c_name": "PERSON"}, ["c_custkey"])
    columns = ("c_custkey", "c_name", "c_mktsegment")
    bodies = lambda df, mode: df.select(F.struct(F.lit(mode).alias("mode"), F.col("c_custkey").alias("key")).alias("body_id"), F.to_json(F.struct(*columns)).alias("body"))
    found = leakscan.leaks(bodies(c, "raw").union(bodies(masked, "substituted")), canaries.limit(0), canaries)
    return found.select("body_id.mode", F.col("body_id.key").alias("body_id"), "id")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
