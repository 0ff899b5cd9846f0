"""Queries over texts: leaks, number words, vocabulary, normalisation."""

from pyspark.sql import functions as F

from curalith.functions import numbers as N
from curalith.functions import text as X
from curalith.functions.normalizer import normalized
from curalith.operators import leak
from curalith.operators.validation import letter_counts as count_letters
from curalith.operators.validation import read_seconds
from curalith.plans.registry import Registry, table
from curalith.sources.tables import dealt

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: A vocabulary for the stand-in tables: letters and marks, without q, ! and some accents.
VOCABULARY = "abcçdefgğhıijklmnoöprsştuüvyzâABCÇDEFGHIİJKLMNOÖPRSŞTUÜVYZ0123456789 .,?:;'-%"

_WORDS = r"""list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(regexp_replace(w, '^[.,;:!?''"]+|[.,;:!?''"]+$', '', 'g'))), lambda w: w <> '')"""
_GRAMS = """
  w_{t} AS (SELECT {k}, {words} AS w FROM {t}),
  g_{t} AS (SELECT DISTINCT {k}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram FROM w_{t})"""
_LEAKS = "WITH" + _GRAMS.format(t="documents", k="doc_id", words=_WORDS) + "," + _GRAMS.format(t="benchmark", k="item_id", words=_WORDS) + """,
  found AS (SELECT doc_id, count(*) AS n_shared, min(gram) AS first_gram FROM g_documents JOIN (SELECT DISTINCT gram FROM g_benchmark) USING (gram) GROUP BY doc_id),
  same AS (SELECT DISTINCT doc_id FROM documents WHERE lower(text) IN (SELECT lower(text) FROM benchmark))
"""


@query(_LEAKS + "SELECT * FROM found")
def leak_ngram(spark, sf_dir):
    return leak.ngram_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT doc_id FROM documents WHERE lower(text) IN (SELECT lower(text) FROM benchmark)")
def leak_exact(spark, sf_dir):
    return leak.exact_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT doc_id FROM documents WHERE lower(text) IN (SELECT lower(text) FROM documents JOIN labels USING (doc_id))")
def leak_exact_labelled(spark, sf_dir):
    """As leak_exact; the evaluation sentences are the texts of the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    return leak.exact_leaks(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))


@query(_LEAKS + "SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NOT NULL THEN 'identical sentence' ELSE 'shared run: ' || first_gram END AS reason FROM found f FULL JOIN same s ON f.doc_id = s.doc_id")
def leak_reasons(spark, sf_dir):
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(_LEAKS + "SELECT source, count(*) AS n_docs, count(found.doc_id) AS n_leaking FROM documents LEFT JOIN found USING (doc_id) GROUP BY source")
def leak_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = leak.ngram_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.lit(1).alias("leaks"))
    return docs.join(found, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("leaks").alias("n_leaking"))


@query()
def leak_normalized(spark, sf_dir):
    """As leak_ngram, both sides in spoken form first."""
    return leak.ngram_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), prepare=normalized)


@query()
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("spoken"))


_NAMES = """
  ones AS (SELECT ['bir','iki','üç','dört','beş','altı','yedi','sekiz','dokuz'] AS o, ['on','yirmi','otuz','kırk','elli','altmış','yetmiş','seksen','doksan'] AS t)"""
_BELOW = "concat_ws(' ', CASE WHEN {n} // 100 > 1 THEN o[({n} // 100)::INT] END, CASE WHEN {n} >= 100 THEN 'yüz' END, t[({n} // 10 % 10)::INT], o[({n} % 10)::INT])"


def _spoken(n: str) -> str:
    parts = []
    for power, name in ((9, "milyar"), (6, "milyon"), (3, "bin")):
        g = f"({n} // {10**power} % 1000)"
        said = _BELOW.format(n=g)
        parts.append(f"CASE WHEN {g} = 1 AND {power} = 3 THEN 'bin' WHEN {g} > 0 THEN concat({said}, ' {name}') END")
    return f"CASE WHEN {n} = 0 THEN 'sıfır' ELSE concat_ws(' ', {', '.join(parts)}, nullif({_BELOW.format(n=f'({n} % 1000)')}, '')) END"


@query(f"WITH {_NAMES}, n AS (SELECT o_orderkey AS k, o_orderkey * 104729 + o_custkey AS n FROM orders) SELECT k, n, {_spoken('n')} AS words FROM n, ones")
def number_words(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 104729 + F.col("o_custkey")).alias("n"))
    return rows.withColumn("words", N.number_to_words(F.col("n")))


@query(f"WITH {_NAMES} SELECT p_partkey, array_to_string(list_transform(string_split(lpad(p_partkey::VARCHAR, 6, '0'), ''), lambda c: CASE WHEN c = '0' THEN 'sıfır' ELSE o[c::INT] END), ' ') AS words FROM part, ones")
def digit_words(spark, sf_dir):
    """Six digits of a key one by one: a shorter one has zeros before it, of a longer one the first six are read."""
    return table(spark, sf_dir, "part").select("p_partkey", N.digits_to_words(F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("words"))


@query(f"""WITH {_NAMES}, a AS (SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT AS n, (l_discount * 100)::INT AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, concat({_spoken('n')}, ' virgül ', CASE WHEN c < 10 THEN 'sıfır' ELSE '' END, CASE WHEN c = 0 THEN ' sıfır' WHEN c < 10 THEN ' ' || o[c] ELSE concat_ws(' ', t[c // 10], o[c % 10]) END) AS words FROM a, ones""")
def amount_words(spark, sf_dir):
    cents = F.lpad((F.col("l_discount") * 100).cast("decimal(9,0)").cast("string"), 2, "0")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.amount_words(F.floor("l_quantity").cast("string"), cents).alias("words"))


#: A spoken form in SQL with a suffix joined to it, and its first letter a capital.
_LAST = "regexp_extract(w, '.*([aeıioöuü])', 1)"
_FOUR = f"CASE WHEN {_LAST} IN ('a','ı') THEN 'ı' WHEN {_LAST} IN ('o','u') THEN 'u' WHEN {_LAST} IN ('ö','ü') THEN 'ü' ELSE 'i' END"
_TWO = f"CASE WHEN {_LAST} IN ('a','ı','o','u') THEN 'a' ELSE 'e' END"
_CAPITAL = "concat(CASE WHEN left({x}, 1) = 'i' THEN 'İ' ELSE upper(left({x}, 1)) END, substr({x}, 2))"
_HARD = "CASE WHEN right(w, 1) IN ('f','s','t','k','ç','ş','h','p') THEN 't' ELSE 'd' END"
_MONTHS = "['Ocak','Şubat','Mart','Nisan','Mayıs','Haziran','Temmuz','Ağustos','Eylül','Ekim','Kasım','Aralık']"


@query(f"""WITH {_NAMES}, d AS (SELECT o_orderkey AS k, day(o_orderdate::DATE) AS d, month(o_orderdate::DATE) AS m, year(o_orderdate::DATE) AS y FROM orders),
  f AS (SELECT k, concat({_spoken('d')}, ' ', {_MONTHS}[m], ' ', {_spoken('y')}) AS w FROM d, ones)
SELECT k, {_CAPITAL.format(x='w')} || {_HARD} || {_FOUR} || 'r.' AS spoken FROM f""")
def spoken_dates(spark, sf_dir):
    """Dates with a suffix, as the normaliser reads them."""
    written = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("’dir."))
    return dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), written.alias("written"))).select("k", normalized(F.col("written")).alias("spoken"))


@query(f"""WITH {_NAMES}, m AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT // 100 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE round(o_totalprice * 100)::BIGINT % 100 END AS c FROM orders)
SELECT k, 'Borç ' || {_spoken('n')} || ' Türk lirası' || CASE WHEN c = 0 THEN 'na' ELSE concat(' ', {_spoken('c')}, ' kuruşa') END || ' indi.' AS spoken FROM m, ones""")
def spoken_money(spark, sf_dir):
    """Amounts with points and a comma, before or behind the currency; each third has no hundredths."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    third = F.col("o_orderkey") % 3 == 0
    amount = F.concat(F.translate(F.format_number(F.call_function("div", cents, F.lit(100)), 0), ",", "."), F.when(third, "").otherwise(F.concat(F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))))
    written = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Borç ₺"), amount, F.lit("'ye  indi."))).otherwise(F.concat(F.lit("Borç "), amount, F.lit(" TL'ye indi.")))
    return dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), written.alias("written"))).select("k", normalized(F.col("written")).alias("spoken"))


@query(f"""WITH {_NAMES}, c AS (SELECT c_custkey AS k, c_custkey % 24 AS h, c_custkey % 60 AS m, c_custkey % 101 AS p FROM customer),
  f AS (SELECT k, concat_ws(' ', {_spoken('h')}, CASE WHEN m BETWEEN 1 AND 9 THEN 'sıfır' END, CASE WHEN m > 0 THEN {_spoken('m')} END) AS w,
    concat('yüzde ', {_spoken('p')}) AS percent, array_to_string(list_transform(string_split(lpad(k::VARCHAR, 12, '0'), ''), lambda x, i: concat(CASE WHEN x = '0' THEN 'sıfır' ELSE o[x::INT] END, CASE WHEN i % 4 = 0 AND i < 12 THEN ',' ELSE '' END)), ' ') AS account FROM c, ones)
SELECT k, concat({_CAPITAL.format(x='w')}, {_HARD}, {_TWO}, ' te re, on iki, ', account, ' ve ka de ve ', percent, ' ö te veyi deşbord') AS spoken FROM f""")
def spoken_records(spark, sf_dir):
    """A time with a suffix, an account number (in groups or not), abbreviations, a percentage and a foreign word."""
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 12, "0")
    account = F.concat(F.lit("TR12"), F.when(key % 2 == 0, digits).otherwise(F.concat(F.lit(" "), F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4), F.lit(" "), F.substring(digits, 9, 4))))
    time = F.concat((key % 24).cast("string"), F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit("'da "))
    written = F.concat(time, account, F.lit(" ve KDV %"), (key % 101).cast("string"), F.lit(" ÖTV'yi dashboard"))
    return dealt(table(spark, sf_dir, "customer").select(key.alias("k"), written.alias("written"))).select("k", normalized(F.col("written")).alias("spoken"))


_BACK = "v IN ('a','ı','o','u')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(nullif(regexp_extract(lower(translate(text, 'Iİ', 'ıi')), '(?s).*([aeıioöuü])', 1), ''), 'e') AS v FROM documents)
SELECT doc_id, v AS last_vowel, CASE WHEN {_BACK} THEN 'a' ELSE 'e' END AS two_way, CASE WHEN {_BACK} THEN CASE WHEN v IN ('o','u') THEN 'u' ELSE 'ı' END WHEN v IN ('ö','ü') THEN 'ü' ELSE 'i' END AS four_way FROM d""")
def vowel_harmony(spark, sf_dir):
    v = X.last_vowel(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("last_vowel"), X.harmonized(F.lit("e"), v).alias("two_way"), X.harmonized(F.lit("i"), v).alias("four_way"))


_quote = lambda s: "'" + s.replace("'", "''") + "'"
_class = lambda chars: "".join(f"\\{c}" if ord(c) < 128 and not c.isalnum() and c != " " else c for c in dict.fromkeys(chars)).replace("'", "''")
_SINGLE = {c: v for c, v in X.stand_ins(VOCABULARY).items() if len(v) == 1}
_DROPPED = "".join(c for c, v in X.stand_ins(VOCABULARY).items() if v == "")
#: The characters, but spaces, for which only a space could stand.
_OUTSIDE = f"list_sort(list_distinct(list_filter(string_split(regexp_replace(text, '[{_class([*VOCABULARY, *X.stand_ins(VOCABULARY)])}]', '', 'g'), ''), lambda c: c <> '')))"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, {_quote(''.join(_SINGLE) + _DROPPED)}, {_quote(''.join(_SINGLE.values()))}), '[^{_class([*VOCABULARY, *_SINGLE.values()])}]', ' ', 'g'), '\\s+', ' ', 'g')) AS fitted FROM documents")
def fit_vocab(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fit_to_vocabulary(F.col("text"), VOCABULARY).alias("fitted"))


@query(f"SELECT doc_id, array_to_string({_OUTSIDE}, '|') AS outside FROM documents")
def unmappable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.unmappable(F.col("text"), VOCABULARY), "|").alias("outside"))


@query("SELECT a.letter, coalesce(n, 0) AS n FROM (SELECT unnest(string_split('abcçdefgğhıijklmnoöprsştuüvyz', '')) AS letter) a LEFT JOIN (SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS letter FROM documents) GROUP BY letter) b USING (letter)")
def letter_counts(spark, sf_dir):
    return count_letters(table(spark, sf_dir, "documents"), "abcçdefgğhıijklmnoöprsştuüvyz")


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(text) / 14.0::DOUBLE + 0.35::DOUBLE * (length(text) - length(replace(text, ',', ''))) AS seconds FROM documents")
def length_estimates(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.letters(text).alias("letters"), read_seconds(text).alias("seconds"))
