"""Personal data, and terms that give it away, in SQL functions alone.

Base kinds are found by patterns. The patterns are the plain ones, changed only
so that they match in time proportional to the text: repeats at the end are
possessive, and a match may only begin where a run of its characters begins.
Card numbers are matched with their bound on digits, since whole runs are.

The information-theoretic step looks at the whole documents that mention an
entity (a found value). Terms are all runs of letters and digits. n(e, t) counts
the documents that hold both entity e and term t, n(t) those that hold t. A term
leaves log2 1/P(e | t) bits of the entity unknown. P(e | t) is n(e, t) / n(t),
smoothed towards zero where few contexts speak for it: times c / (c + ``prior``)
for c different contexts of e in documents with t. A term is disclosing when that
reaches ``disclosure`` (one bit is left at 0.5). Every occurrence of a disclosing term is
marked, in all texts, by its highest share: at ``removal`` or more it is removed,
else generalised. Copies of one passage are one context.

Defined results: a null or empty text has no spans; repeated rows are judged one
by one (and their mentions counted as often), rows with a null id like others.
Base spans always stay; a term span that overlaps one is left out.
Columns besides id and text pass through ``sanitise`` untouched.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import materialize, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: kind -> (pattern, test on the value x, text that any match needs)
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "true", "@"),
    "ip": (
        r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "forall(split(x, '[.]'), p -> p rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
        ".",
    ),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "luhn_check(regexp_replace(x, '[ -]', ''))", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(x, '[^0-9]', '')) between 10 and 15", "+"),
}
TERM = r"[\p{L}\p{N}]+"
REACH = 64
BROADCAST_BYTES = 48 << 20
_SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def running(x: str, zero: str, op: str, depth: int = 4) -> str:
    """SQL: for each place of the array ``x`` (a bound name; of what ``op`` gives) the sum, or other ``op`` of ``s`` and ``y``, of what stands before it.

    Blocks of 16 are summed first, and their sums in the same way, so that the
    cost follows the array's length; growing an array match by match would follow its square.
    """
    fold = lambda part, start: f"aggregate({part}, {start}, (s, y) -> {op})"
    if not depth:
        return f"transform({x}, (v, i) -> {fold(f'slice({x}, 1, i)', zero)})"
    b, q = f"b{depth}", f"q{depth}"
    blocks = f"transform(sequence(0, (size({x}) - 1) div 16), k -> {fold(f'slice({x}, cast(k * 16 + 1 as int), 16)', zero)})"
    inside = f"transform({x}, (v, i) -> {fold(f'slice({x}, i - i % 16 + 1, i % 16)', f'{q}[cast(i div 16 as int)]')})"
    return _let(blocks, b, _let(running(b, zero, op, depth - 1), q, inside))


def _matches(text: str, pattern: str, kind: int, value: str) -> str:
    """SQL: matches of a pattern as (start, kind, end, value), from the lengths of the gaps between them; ``value`` may use the match ``w``."""
    quoted = _quoted(pattern)
    found = f"transform(h, (w, i) -> named_struct('start', p[i] + length(g[i]), 'kind', {kind}, 'end', p[i] + length(g[i]) + length(w), 'value', {value}))"
    lengths = "transform(h, (w, i) -> cast(length(g[i]) + length(w) as bigint))"
    found = _let(lengths, "l", _let(running("l", "0L", "s + y"), "p", found))
    return _let(f"split({text}, '{quoted}', -1)", "g", _let(f"regexp_extract_all({text}, '{quoted}', 0)", "h", f"if(size(h) = 0, cast(array() as {_SPANS}), {found})"))


def spans(text: str, pattern: str, kind: int, test: str = "true") -> str:
    return f"filter({_matches(text, pattern, kind, 'w')}, m -> exists(array(m.value), x -> {test}))"


#: a text in pieces of equal length, since what is cut from a string is looked for from its beginning
CHUNK = 1024
_CHUNKS = f"regexp_extract_all({{}}, '(?s).{{{{1,{CHUNK}}}}}', 0)"


def _chunks(text: str) -> str:
    return _CHUNKS.format(text)


def _cut(chunks: str, start: str, end: str) -> str:
    """SQL: the characters from ``start`` to ``end`` of a text in chunks."""
    inside = f"substring({chunks}[cast(k as int)], cast(greatest({start} - k * {CHUNK}, 0L) as int) + 1, cast(least({end} - k * {CHUNK}, {CHUNK}L) - greatest({start} - k * {CHUNK}, 0L) as int))"
    return f"if({end} > {start}, array_join(transform(sequence({start} div {CHUNK}, ({end} - 1) div {CHUNK}), k -> {inside}), ''), '')"


def base_spans(text: str) -> str:
    parts = []
    for kind, (pattern, test, needs) in PATTERNS.items():
        found = spans(text, pattern, KINDS.index(kind), test)
        guard = f"instr({text}, '{needs}') > 0" if needs else f"{text} rlike '[0-9][0-9 -]{{12}}'"
        parts.append(f"if({guard}, {found}, cast(array() as {_SPANS}))")
    return f"array_sort(concat({', '.join(parts)}))"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{_quoted(TERM)}', 0)"


def _terms(text: str) -> str:
    return f"array_distinct(transform({_words(text)}, x -> lower(x)))"


def _pairs(found: DataFrame, least: int) -> DataFrame:
    """(entity, term, both, contexts): documents that hold both, and in how many different contexts; entities with fewer than ``least`` cannot tell."""
    around = f"xxhash64({_cut('chunks', f'greatest(0L, m.start - {REACH})', 'm.start')}, {_cut('chunks', 'm.end', f'least(m.end + {REACH}, size)')})"
    # one context of each entity in a document: the least
    held = F.expr(f"array_sort(transform(base, m -> named_struct('entity', concat(m.kind, ':', lower(m.value)), 'context', {around})))")
    rows = found.where("size(base) > 0").withColumns({"chunks": F.expr(_chunks("text")), "size": F.length("text").cast("long")}).select(F.expr(_terms("text")).alias("terms"), held.alias("held"))
    rows = rows.select("terms", F.inline(F.expr("filter(held, (x, i) -> i = 0 or held[greatest(i - 1, 0)].entity != x.entity)")))
    often = materialize(rows.groupBy("entity").agg(F.count_distinct("context").alias("n")).where(F.col("n") >= least).select("entity"), "entities")
    bound = often.agg(F.coalesce(F.sum(F.expr("64 + octet_length(entity)")), F.lit(0))).first()[0]
    near = rows.join(F.broadcast(often) if bound <= BROADCAST_BYTES else often, "entity").select("entity", "context", F.explode("terms").alias("term"))
    return near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("m")).groupBy("entity", "term").agg(F.sum("m").alias("both"), F.count(F.lit(1)).alias("contexts"))


def _every_occurrence(rows: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc, mark, more): all places of the terms of ``telling`` (term, value), wherever they stand in whichever text."""
    bound = telling.agg(F.coalesce(F.sum(F.expr("64 + octet_length(term)")), F.lit(0))).first()[0]
    words = rows.select("doc", "mark", F.explode(F.expr(f"array_distinct({_words('text')})")).alias("word")).select("doc", "mark", F.lower("word").alias("term"))
    hits = words.join(F.broadcast(telling) if bound <= BROADCAST_BYTES else telling, "term").groupBy("doc", "mark").agg(F.collect_set(F.struct("term", "value")).alias("hits"))
    hits = materialize(hits.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.map_from_entries("hits").alias("hits")), "hits")
    bound = hits.agg(F.coalesce(F.sum(F.expr("64 + aggregate(map_keys(hits), 0L, (s, t) -> s + 64 + octet_length(t))")), F.lit(0))).first()[0]
    texts = rows.join(F.broadcast(hits) if bound <= BROADCAST_BYTES else hits, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    places = f"filter({_matches('text', TERM, 4, 'try_element_at(hits, lower(w))')}, x -> x.value is not null)"
    # a repeated row has the places of the first
    return texts.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.expr(places).alias("more")).groupBy("_doc", "_mark").agg(F.first("more").alias("more"))


def find_personal_data(docs: DataFrame, disclosure: float = 0.5, removal: float = 0.9, prior: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and text: ``doc``, ``mark`` (hash of the text), ``base`` and ``spans`` (base and terms), in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = rows.withColumn("base", F.expr(base_spans("text")))
    # texts with spans go along once, for their contexts; of others only the id
    found = materialize(found.withColumn("text", F.expr("if(size(base) > 0, text, null)")), "spans")
    # no share of fewer contexts reaches ``disclosure``
    least = max(1, ceil(disclosure * prior / (1 - disclosure) - 1e-9)) if disclosure < 1 else 1
    pairs = materialize(_pairs(found, least).where(F.col("contexts") >= least), "pairs")
    found, telling = found.drop("text"), None
    if not pairs.isEmpty():
        # all words are counted, then joined: what is joined follows the pairs, not the texts
        said = rows.select(F.explode(F.expr(_terms("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        share = pairs.join(said, "term").select("term", (F.col("both") / F.greatest("n", "both") * F.col("contexts") / (F.col("contexts") + prior)).alias("share")).where(F.col("share") >= disclosure).groupBy("term").agg(F.max("share").alias("share"))
        telling = materialize(share.select("term", F.when(F.col("share") >= removal, "").otherwise("[TERM]").alias("value")), "telling")
    if telling is not None and not telling.isEmpty():
        more = _every_occurrence(rows, telling)
        out = found.join(more, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").drop("_doc", "_mark")
    else:
        out = found.withColumn("more", F.lit(None).cast(_SPANS))
    return out.select("doc", "mark", "base", F.expr(f"if(more is null or size(more) = 0, base, {_without_overlaps('base', 'more')})").alias("spans"))


def _without_overlaps(base: str, more: str) -> str:
    """SQL: both kinds of spans in order, without those of ``more`` that overlap one of ``base``: by the last end before and the first start after."""
    far = "9223372036854775807L"
    ends = _let("transform(a, x -> if(x.kind < 4, x.end, 0L))", "z", running("z", "0L", "greatest(s, y)"))
    starts = _let(f"transform(r, x -> if(x.kind < 4, x.start, {far}))", "z", running("z", far, "least(s, y)"))
    kept = "filter(a, (x, i) -> x.kind < 4 or (e[i] <= x.start and f[size(a) - 1 - i] >= x.end))"
    return _let(f"array_sort(concat({base}, {more}))", "a", _let("reverse(a)", "r", _let(ends, "e", _let(starts, "f", kept))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span of the text replaced: base kinds and generalised terms by a label, removed terms by nothing."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, **options).where("size(spans) > 0").select("doc", "mark", "spans").dropDuplicates(["doc", "mark"])
    labels = ", ".join(f"'[{k.upper()}]'" for k in KINDS[:4])
    # overlapping spans are replaced once, from where the text has been copied to
    label = f"if(x.kind = 4, x.value, array({labels})[x.kind])"
    parts = f"transform(_spans, (x, i) -> concat({_cut('c', 't[i]', 'x.start')}, if(x.end > t[i], {label}, '')))"
    last = "aggregate(_spans, 0L, (s, y) -> greatest(s, y.end))"
    tail = _cut("c", last, f"cast(length(`{text_col}`) as bigint)")
    rebuilt = _let(_chunks(f"`{text_col}`"), "c", _let(_let("transform(_spans, x -> x.end)", "z", running("z", "0L", "greatest(s, y)")), "t", f"concat(array_join({parts}, ''), {tail})"))
    mark, doc, held = (unused(docs.columns, c) for c in ("_mark", "_doc", "_spans"))
    rebuilt = rebuilt.replace("_spans", f"`{held}`")
    found = materialize(found, "found")
    bound = found.agg(F.coalesce(F.sum(F.expr("64 + 64 * size(spans)")), F.lit(0))).first()[0]
    found = found.toDF(doc, mark, held)
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    joined = docs.join(F.broadcast(found) if bound <= BROADCAST_BYTES else found, docs[id_col].eqNullSafe(found[doc]) & (key == found[mark]), "left")
    return joined.withColumn(text_col, F.expr(f"if(`{held}` is null, `{text_col}`, {rebuilt})")).select(*docs.columns)


def _listed(column: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select(F.col("doc").alias("doc_id"), *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
