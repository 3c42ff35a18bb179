"""Language identification by Bayesian evidence fusion.

The log odds of a page add up: the likelihood of its text under character n-gram models of each language, that of the language its markup declares, that
of its address's suffix, and a prior of its host. Every count behind them is a grouped aggregation over whole tables; the priors are smoothed from all
pages to registered domains to hosts, so a host with few pages takes after its domain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import batches, stored, strings

BITS = 14
BUCKETS = 1 << BITS
SMOOTH = 0.5
#: Characters of a text do not speak independently: its log-likelihood is divided by this, and no text says more than CEILING.
TEMPER, CEILING = 8.0, 30.0
#: Pages' worth of the parent's distribution that a domain's and a host's own counts start from; votes each suffix and declaration starts from.
PARENT, VOTES = 5.0, 1.0
#: More languages than this are refused: the models that every task gets hold BUCKETS numbers a language.
MOST_LANGUAGES = 256
#: Elements whose content is not seen.
HIDDEN = ("script", "style", "noscript", "template")
OPENS = re.compile(rf"<(?:(!--)|({'|'.join(HIDDEN)})\b|(?=[A-Za-z/!?]))", re.IGNORECASE)
CLOSES = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in HIDDEN} | {"!--": re.compile("-->"), "": re.compile(">")}
#: The attribute in an ``html`` tag; what white space and quotes take is not given back, so a tag of any length is read once.
DECLARED = re.compile(r"(?<![-\w:])lang\s*+=\s*+[\"']?+\s*+([A-Za-z]{2,3})\b", re.IGNORECASE)
HTML = re.compile(r"<html\b", re.IGNORECASE)
#: A country's suffix under which others register one label further down is known by these second labels.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "mil", "ne", "net", "nom", "or", "org")
DOMAIN = rf"([^.]+\.(?:(?:{'|'.join(SECOND)})\.[a-z]{{2}}|[^.]+))$"


def grams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of the lower-cased text, white space as one space."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.uint32)
    h = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]
    return (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def read_markup(html: str) -> tuple[str, str | None]:
    """(text, declared): the whole text without markup, comments and hidden elements, and the language that the first ``html`` tag with one declares.

    What is opened and never closed counts as its tag, or as text. Tags in comments and hidden elements declare nothing. One pass.
    """
    out, at, missing, said = [], 0, set(), None

    def end(kind: str, start: int) -> int:
        """Where the closing mark ends, -1 without one; a mark once missed is not looked for again."""
        if kind in missing:
            return -1
        if m := CLOSES[kind].search(html, start):
            return m.end()
        missing.add(kind)
        return -1

    while m := OPENS.search(html, at):
        out.append(html[at : m.start()])
        kind = (m.group(1) or m.group(2) or "").lower()
        till = end(kind, m.end()) if kind else -1
        till = end("", m.end()) if till < 0 else till
        if till < 0:
            out.append("<")
            at = m.start() + 1
        else:
            if said is None and not kind and HTML.match(html, m.start()):
                said = DECLARED.search(html, m.start(), till)
            out.append(" ")
            at = till
    return unescape("".join([*out, html[at:]])), said.group(1).lower() if said else None


def visible(html: str) -> str:
    return read_markup(html)[0]


def declared(html: str) -> str | None:
    return read_markup(html)[1]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and bucket) from the counts over all whole texts that have a language."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches(rows):
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)).to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams(text), minlength=BUCKETS)
        for lang, own in total.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(own[found])], ["lang", "bucket", "n"])

    texts = docs.select(F.lower(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND lang != ''")
    if texts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = texts.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages times BUCKETS numbers at most
    names = rows.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    table = np.full((len(langs), BUCKETS), SMOOTH)
    order = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    if langs:
        table[order[names.indices.to_numpy()], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if langs else np.zeros((0, BUCKETS), np.float32)


def _shares(rows: list, key: str, langs: list[str]) -> dict[str, np.ndarray]:
    """log P(key | language), smoothed, from rows (key, lang, n)."""
    keys = {x: i for i, x in enumerate(sorted({r[key] for r in rows}))}
    at = {x: i for i, x in enumerate(langs)}
    table = np.full((len(keys) + 1, len(langs)), VOTES)
    for r in rows:
        table[keys[r[key]], at[r["lang"]]] += r["n"]
    table = np.log(table / table.sum(0))
    return {k: table[i] for k, i in keys.items()}


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, lang, probability, text_lang, declared, host.

    The n-gram models are trained on ``docs`` (text, lang) and read all visible text of a page. P(declared | language), P(suffix | language) and the priors are counted over all pages by the
    language that text alone makes likeliest. Missing evidence (null or empty html, no lang attribute, null url) counts for nothing, so a page without
    any gets the prior; ties go to the first language by name; without trained languages lang and probability are null. Null ids and repeated rows are
    rows of their own; other columns are ignored. Only tables bounded by the languages (MOST_LANGUAGES) and declarations (of three letters) are sent out;
    suffixes, domains and hosts are joined. A registered domain is the last two labels, or three under a country's second-level suffix.
    """
    langs, logs = train(docs)
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(logs)

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches(rows):
            likely, said = [], []
            for html in strings(batch.column(2)).to_pylist():
                text, language = read_markup(html)
                found = np.bincount(grams(text), minlength=BUCKETS)
                at = np.flatnonzero(found)
                z = table[:, at] @ found[at] / TEMPER if len(at) else np.zeros(len(table))
                z = np.maximum(z - z.max(initial=-np.inf), -CEILING) if len(z) else z
                likely.append(z.tolist())
                said.append(language)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(likely, pa.list_(pa.float64()))], ["id", "url", "declared", "likely"])

    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = base.mapInArrow(read, f"id {base.schema['id'].dataType.simpleString()}, url string, declared string, likely array<double>")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = rows.withColumn("host", F.when(host != "", host)).drop("url")
    rows = rows.withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("host", DOMAIN, 1), F.lit("")), "host")).withColumn("suffix", F.substring_index("host", ".", -1))
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.expr("CAST(array() AS array<string>)")
    best = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    rows = rows.withColumn("text_lang", F.when(F.array_min("likely") < F.array_max("likely"), best(F.col("likely"))))
    rows = stored(rows, "lang-rows")
    known = rows.where("text_lang IS NOT NULL").withColumnRenamed("text_lang", "lang")
    said = known.where("declared IS NOT NULL").groupBy("declared", "lang").agg(F.count(F.lit(1)).alias("n")).collect()
    everywhere = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = np.array([everywhere.get(x, 0) + 1.0 for x in langs])
    top = top / top.sum() if langs else top
    by_said = _shares(said, "declared", langs)
    each = [F.sum(F.when(F.col("lang") == x, 1).otherwise(0)).cast("double") for x in langs]
    per_language = F.array(*each) if langs else F.expr("CAST(array() AS array<double>)")

    def counts(*keys: str) -> DataFrame:
        return known.where(f"{keys[0]} IS NOT NULL").groupBy(*keys).agg(per_language.alias("own"))

    # log P(suffix | language): as for declarations, with one more suffix that was never met
    ends = stored(counts("suffix"), "lang-suffixes")
    met = ends.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("own", F.lit(i))) for i in range(len(langs))]).cast("array<double>").alias("all")).first()
    totals = F.array(*[F.lit(VOTES * (met["n"] + 1) + (x or 0.0)) for x in met["all"]]).cast("array<double>")
    ends = ends.select(F.col("suffix").alias("s_suffix"), F.zip_with("own", totals, lambda n, total: F.log((n + VOTES) / total)).alias("suffix_said"))
    above = F.array(*[F.lit(float(x)) for x in top]) if langs else F.expr("CAST(array() AS array<double>)")
    smooth = "transform(zip_with({own}, {parent}, (a, b) -> a + {p}D * b), x -> x / (aggregate({own}, 0D, (s, y) -> s + y) + {p}D))"
    domains = counts("domain").withColumn("above", above).select("domain", F.expr(smooth.format(own="own", parent="above", p=PARENT)).alias("domain_prior"))
    hosts = counts("host", "domain").join(domains, "domain").select(F.col("host").alias("h_host"), F.expr(smooth.format(own="own", parent="domain_prior", p=PARENT)).alias("prior"))
    evidence = spark.sparkContext.broadcast(by_said)
    joined = rows.join(ends, F.col("suffix") == F.col("s_suffix"), "left").join(stored(hosts, "lang-hosts"), F.col("host") == F.col("h_host"), "left").withColumn("prior", F.coalesce("prior", above))

    def fuse(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said_ = evidence.value
        none = np.zeros(len(langs))
        for batch in batches_:
            lang, chance = [], []
            for r in zip(*(batch.column(c).to_pylist() for c in ("likely", "declared", "suffix_said", "prior")), strict=True):
                if not langs:
                    lang.append(None)
                    chance.append(None)
                    continue
                z = np.array(r[0]) + said_.get(r[1], none) + (none if r[2] is None else np.array(r[2])) + np.log(r[3])
                p = np.exp(z - z.max())
                lang.append(langs[int(p.argmax())])
                chance.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(chance, pa.float64()), *(batch.column(c) for c in ("text_lang", "declared", "host"))], ["id", "lang", "probability", "text_lang", "declared", "host"])

    out = joined.select("id", "likely", "declared", "suffix_said", "prior", "text_lang", "host").mapInArrow(fuse, f"id {base.schema['id'].dataType.simpleString()}, lang string, probability double, text_lang string, declared string, host string")
    return out.withColumnRenamed("id", id_col)
