"""Line deduplication by a log-template tree, with DataFrame functions only.

Every line is a path of fixed depth: its token count, then its leading tokens, with tokens that hold digits
taken as variable. Equal masked lines are one template at once. Where a leaf of the tree holds several masked
lines, each position keeps its most frequent token if at least half of those lines have it, and is variable
otherwise; lines that agree with this leaf template in at least `similarity` of all tokens belong to it, the
others stay templates of their own. A template found in two documents or more is recurring; of its lines only
the first (by doc_id, then line) stays.

With `several`, as in the pipeline, a leaf holds any number of templates: its lines that don't belong to the leaf
template are split by the tokens of the position at which most of them share a token with another, single tokens
together, and each part is treated as a leaf, until no part has lines that share a token which others lack.

Lines need at least `min_words` constant tokens, and at least half of their tokens constant, to be judged. With
`min_chars`, as in the pipeline, other lines of so many characters are templates by exact equality, digits included.
The query `op10_line_dedup` uses neither option, as its SQL defines it.
Defined results: null and empty texts keep one empty line; a document without any line left becomes empty but
stays; rows equal in doc_id and text count as one document and are treated alike; a null doc_id is the lowest;
extra columns are kept by `without_recurring_lines`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, stored, table

BLANKS = r"[\x20\x09-\x0D]"
VARIABLE = "<*>"


def plain_line(line: Column) -> Column:
    """A line with single blanks between its tokens."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for blank in "\t\x0b\x0c\r":
        odd = odd | line.contains(blank)
    return F.when(odd, F.trim(F.regexp_replace(line, BLANKS + "+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """A line with single blanks between its tokens, tokens with digits made variable."""
    plain = plain_line(line)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^\x20]*[0-9][^\x20]*", VARIABLE)).otherwise(plain)


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def document_key(docs: DataFrame) -> list[Column]:
    """What names a document: its id and the hash of its text."""
    return [F.col("doc_id").alias("doc_"), F.xxhash64("text").alias("text_")]


def lines_of(docs: DataFrame, min_words: int, depth: int, min_chars: int | None = None) -> DataFrame:
    """A row for each line that is judged: document, line number, masked line, leaf of the tree.

    Lines that are only judged as they stand begin with a line feed, which no line holds, and have no leaf.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def enough(m, n, v):
        return (F.length(m) > 0) & (n - v >= min_words) & (2 * v <= n)

    def form(x):
        m = x["m"]
        whole = F.when(F.length(x["p"]) >= min_chars, F.concat(F.lit("\n"), x["p"])).otherwise("")
        return F.when(enough(m, _count(m, " ") + 1, _count(m, VARIABLE)), m).otherwise(whole)

    # Masking happens inside the generator, so that no later filter or hash repeats it.
    split = F.split(text, "\n", -1)
    forms = F.transform(split, masked) if min_chars is None else F.transform(F.transform(split, lambda x: F.struct(plain_line(x).alias("p"), masked(x).alias("m"))), form)
    lines = docs.select(*document_key(docs), F.posexplode(forms).alias("line_", "m_"))
    lines = lines.withColumn("n_", _count(F.col("m_"), " ") + 1).withColumn("v_", _count(F.col("m_"), VARIABLE))
    leaf = F.xxhash64("n_", F.substring_index("m_", " ", depth))
    if min_chars is None:
        return lines.where(enough(F.col("m_"), F.col("n_"), F.col("v_"))).withColumn("leaf_", leaf)
    return lines.where(F.length("m_") > 0).withColumn("leaf_", F.when(~F.col("m_").startswith("\n"), leaf))


def _template_members(lines: DataFrame, similarity: float) -> DataFrame:
    """h1_, h2_ and leaf_ of the lines (h1_, h2_, leaf_, words_) that belong to the template of their leaf."""
    tokens = lines.select("h1_", "h2_", "leaf_", F.size("words_").alias("n_"), F.posexplode("words_").alias("at_", "token_"))
    votes = tokens.groupBy("leaf_", "at_", "token_").agg(F.count("*").alias("c_"))
    top = votes.groupBy("leaf_", "at_").agg(F.min(F.struct((-F.col("c_")).alias("c_"), "token_")).alias("top_"), F.sum("c_").alias("all_"))
    constant = top.where("-2 * top_.c_ >= all_").select("leaf_", "at_", F.col("top_.token_").alias("token_"))
    agree = tokens.join(constant, ["leaf_", "at_", "token_"], "left_semi").groupBy("h1_", "h2_").agg(F.count("*").alias("agree_"), F.first("n_").alias("n_"), F.first("leaf_").alias("leaf_"))
    return agree.where(F.col("agree_") >= similarity * F.col("n_")).select("h1_", "h2_", "leaf_")


def _parts(rest: DataFrame) -> DataFrame:
    """The lines of each leaf dealt to parts by the tokens of one position; parts of one line are left out."""
    tokens = rest.select("leaf_", F.posexplode("words_").alias("at_", "token_"))
    votes = tokens.groupBy("leaf_", "at_", "token_").agg(F.count("*").alias("c_"))
    shared = F.col("c_") > 1
    places = votes.groupBy("leaf_", "at_").agg(F.sum("c_").alias("all_"), F.max("c_").alias("most_"), F.sum(F.when(shared, F.col("c_")).otherwise(0)).alias("covered_"), F.count(F.when(shared, 1)).alias("kinds_"))
    # A position is used once: within a part its tokens are all equal, or all different.
    places = places.where("most_ > 1 and most_ < all_").groupBy("leaf_").agg(F.min(F.struct((-F.col("covered_")).alias("c_"), "kinds_", "at_")).alias("best_"))
    dealt = rest.join(places, "leaf_").withColumn("at_", F.col("best_.at_")).withColumn("token_", F.element_at("words_", F.col("best_.at_") + 1)).drop("best_")
    dealt = dealt.join(votes.where(shared).select("leaf_", "at_", "token_", "c_"), ["leaf_", "at_", "token_"], "left")
    part = F.when(F.col("c_").isNull(), F.xxhash64("leaf_", "at_")).otherwise(F.xxhash64("leaf_", "at_", "token_"))
    dealt = dealt.select("h1_", "h2_", part.alias("leaf_"), "words_")
    return dealt.join(dealt.groupBy("leaf_").count().where("count > 1").select("leaf_"), "leaf_", "left_semi").select("h1_", "h2_", "leaf_", "words_")


def several_templates(hit: DataFrame, similarity: float) -> DataFrame:
    """h1_, h2_ and of_leaf_ (a name of the template) of the lines (h1_, h2_, leaf_, m_) that belong to any template."""
    lines, out = hit.select("h1_", "h2_", "leaf_", F.split("m_", " ").alias("words_")), None
    while True:
        found = stored(_template_members(lines, similarity), "members")
        out = found if out is None else out.unionByName(found)
        lines = stored(_parts(stored(lines.join(found, ["h1_", "h2_"], "left_anti"), "rest")), "parts")
        if lines.isEmpty():
            return out.withColumnRenamed("leaf_", "of_leaf_")


def recurring_lines(docs: DataFrame, min_words: int = 3, depth: int = 3, similarity: float = 0.8, several: bool = False, min_chars: int | None = None) -> DataFrame:
    """doc_, text_ and the array of line numbers to drop, for each document that has any."""
    lines = lines_of(docs, min_words, depth, min_chars)
    found = stored(lines.select("doc_", "text_", "line_", F.xxhash64("m_").alias("h1_"), F.xxhash64(F.lit(1), "m_").alias("h2_"), "leaf_"), "lines")
    here = F.struct("doc_", "text_", "line_")
    document = F.struct("doc_", "text_")
    exact = found.groupBy("h1_", "h2_").agg(F.min(here).alias("first_"), F.min(document).alias("low_"), F.max(document).alias("high_"), F.min("leaf_").alias("leaf_"))
    exact = stored(exact, "templates")

    # Leaves with several masked lines: fetch the text of each line once, from the first document that has it.
    shared = exact.where("leaf_ is not null").groupBy("leaf_").count().where("count > 1").select("leaf_")
    crowded = exact.join(shared, "leaf_", "left_semi").select("h1_", "h2_", "leaf_", "first_.*")
    wanted = crowded.groupBy("doc_", "text_").agg(F.collect_list(F.struct("line_", "h1_", "h2_", "leaf_")).alias("want_"))
    own = docs.select(*document_key(docs), F.col("text").alias("whole_"))
    hit = _same_document(own, wanted, "inner").select(F.split("whole_", "\n", -1).alias("all_"), "want_")
    hit = hit.select("all_", F.explode("want_").alias("w_")).select("w_.h1_", "w_.h2_", "w_.leaf_", masked(F.element_at("all_", F.col("w_.line_") + 1)).alias("m_"))
    hit = stored(hit.dropDuplicates(["h1_", "h2_"]), "leaf-lines")
    if several:
        members = several_templates(hit, similarity)
    else:
        tokens = hit.select("h1_", "h2_", "leaf_", F.posexplode(F.split("m_", " ")).alias("at_", "token_"))
        votes = tokens.groupBy("leaf_", "at_", "token_").agg(F.count("*").alias("n_"))
        top = votes.groupBy("leaf_", "at_").agg(F.min(F.struct((-F.col("n_")).alias("n_"), "token_")).alias("top_"), F.sum("n_").alias("all_"))
        constant = top.where("-2 * top_.n_ >= all_").select("leaf_", "at_", F.col("top_.token_").alias("token_"))
        agree = tokens.join(constant, ["leaf_", "at_", "token_"], "left_semi").groupBy("h1_", "h2_").agg(F.count("*").alias("agree_"))
        sizes = hit.select("h1_", "h2_", "leaf_", (_count(F.col("m_"), " ") + 1).alias("n_"))
        members = sizes.join(agree, ["h1_", "h2_"]).where(F.col("agree_") >= similarity * F.col("n_")).select("h1_", "h2_", F.col("leaf_").alias("of_leaf_"))

    # Templates: a leaf's, or a masked line of its own.
    named = exact.drop("leaf_").join(members, ["h1_", "h2_"], "left")
    key = [F.coalesce("of_leaf_", "h1_").alias("k1_"), F.when(F.col("of_leaf_").isNull(), F.col("h2_")).alias("k2_")]
    named = stored(named.select("h1_", "h2_", *key, "first_", "low_", "high_"), "named")
    whole = named.groupBy("k1_", "k2_").agg(F.min("first_").alias("keep_"), F.min("low_").alias("low_"), F.max("high_").alias("high_"))
    whole = whole.where(~F.col("low_").eqNullSafe(F.col("high_"))).select("k1_", "k2_", "keep_")
    same = (named["k1_"] == whole["k1_"]) & named["k2_"].eqNullSafe(whole["k2_"])
    drop = named.join(whole, same).select("h1_", "h2_", "keep_")
    gone = found.join(drop, ["h1_", "h2_"]).where(~F.struct("doc_", "text_", "line_").eqNullSafe(F.col("keep_")))
    return gone.groupBy("doc_", "text_").agg(F.collect_set("line_").alias("drop_"))


def _same_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on document keys; right's key columns are left out."""
    right = right.withColumnsRenamed({"doc_": "right_doc_", "text_": "right_text_"})
    on = left["doc_"].eqNullSafe(right["right_doc_"]) & left["text_"].eqNullSafe(right["right_text_"])
    return left.join(right, on, how).drop("right_doc_", "right_text_")


def without_recurring_lines(docs: DataFrame, counts: bool = False, **options) -> DataFrame:
    """docs with recurring lines taken out of text; with counts, also n_lines_ and n_dropped_."""
    columns = docs.columns
    drop = settled(docs.sparkSession, lambda: recurring_lines(docs, **options), "dropped-lines")
    # The row travels as one struct, so no column of the table can clash with those of the join.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row_"), F.col("text").alias("whole_"), *document_key(docs))
    joined = _same_document(rows, drop, "left")
    lines = F.split(F.coalesce("whole_", F.lit("")), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("drop_", i)), "\n")
    extra = [F.size(lines).cast("long").alias("n_lines_"), F.coalesce(F.size("drop_"), F.lit(0)).cast("long").alias("n_dropped_")] if counts else []
    text = F.when(F.col("drop_").isNull(), F.col("whole_")).otherwise(left)
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"row_.`{c}`").alias(c) for c in columns), *extra)


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_recurring_lines(docs, counts=True)
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 line from documents
), plain as (
  select doc_id, line, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') p from lines
), masked as (
  select doc_id, line, regexp_replace(p, '[^\x20]*[0-9][^\x20]*', '<*>', 'g') m from plain where p <> ''
), judged as (
  select *, len(string_split(m, ' ')) n, (length(m) - length(replace(m, '<*>', ''))) // 3 v from masked
), kept_lines as (
  select doc_id, line, m, n, n || ' ' || array_to_string(string_split(m, ' ')[1:3], ' ') leaf from judged where n - v >= 3 and 2 * v <= n
), exact as (
  select m, any_value(n) n, any_value(leaf) leaf, min(doc_id) low, max(doc_id) high from kept_lines group by m
), several as (
  select * from exact where leaf in (select leaf from exact group by leaf having count(*) > 1)
), tokens as (
  select m, n, leaf, unnest(string_split(m, ' ')) token, generate_subscripts(string_split(m, ' '), 1) pos from several
), votes as (
  select leaf, pos, token, count(*) c from tokens group by all
), best as (
  select leaf, pos, token, c, row_number() over (partition by leaf, pos order by c desc, token) r, sum(c) over (partition by leaf, pos) total from votes
), constant as (
  select leaf, pos, token from best where r = 1 and 2 * c >= total
), members as (
  select m, any_value(t.leaf) leaf from tokens t join constant using (leaf, pos, token) group by m having count(*) >= 0.8 * any_value(n)
), named as (
  select e.m, case when b.m is null then 'line ' || e.m else 'leaf ' || b.leaf end template, low, high from exact e left join members b on e.m = b.m
), recurring as (
  select template from named group by template having min(low) <> max(high)
), hits as (
  select doc_id, line, row_number() over (partition by template order by doc_id, line) r
  from kept_lines join named using (m) join recurring using (template)
), dropped as (
  select doc_id, line from hits where r > 1
), rest as (
  select l.doc_id, count(*) n_lines, count(d.line) n_dropped, coalesce(string_agg(l.raw, chr(10) order by l.line) filter (where d.line is null), '') kept
  from lines l left join dropped d on l.doc_id = d.doc_id and l.line = d.line group by l.doc_id
)
select doc_id, n_lines, n_dropped, sha256(kept) kept_sha256 from rest
"""
