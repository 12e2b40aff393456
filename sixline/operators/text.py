"""Text features as native columns: cleaning, markup, domains, keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that place a text in a domain.
DOMAINS = {
    "states": ["hexagram", "state", "phase"],
    "voice": ["voice", "speak", "tone"],
    "mathematics": ["<math", "formula", "matrix"],
    "logs": ["router", "slider", "registry", "parser"],
    "places": ["harbor", "tower", "valley", "river"],
}


#: Unicode white space, and what ends a line.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def cleaned_line(line: Column) -> Column:
    """A scanned line without words in capitals, digits and odd signs, white space squeezed; page marks become empty.

    Letters of every script, both kinds of quotes and dashes stay.
    """
    bare = F.regexp_replace(line, f"^[{WHITE}]+|[{WHITE}]+$", "")
    t = F.regexp_replace(F.regexp_replace(bare, "[A-Z]{2,}", ""), "[0-9]+", "")
    t = F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}_{WHITE}.,;:'\"!?\\-—]", " ")
    t = F.trim(F.regexp_replace(t, f"[{WHITE}]+", " "))
    return F.when(bare.startswith("--- PAGE") | bare.startswith("OF ") | bare.rlike("^PAGE [0-9]+"), "").otherwise(t)


def cleaned(text: Column) -> Column:
    """A scanned text, cleaned line by line; empty lines are dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, LINE_ENDS), cleaned_line), lambda l: l != ""), "\n")


def paragraphs(documents: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, place, paragraph: what blank lines part, if longer than ``least``."""
    parts = F.transform(F.split("text", r"\n[\s]*\n"), lambda p: F.regexp_replace(p, f"^[{WHITE}]+|[{WHITE}]+$", ""))
    return documents.select("doc_id", F.posexplode(F.filter(parts, lambda p: F.length(p) > least)).alias("place", "paragraph"))


def sentence_chunks(text: Column, limit: int = 800, overlap: int = 100, least: int = 40) -> Column:
    """Sentences gathered into chunks up to ``limit``; a full chunk's last ``overlap`` signs begin the next.

    A fold over the sentences; chunks of up to ``least`` signs are dropped.
    """
    sentences = F.split(text, r"(?<=[.!?])[" + WHITE + r"]+")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(state, sentence):
        fits = F.length(state["now"]) + F.length(sentence) + 1 <= limit
        full = F.trim(state["now"])
        grown = F.when(full != "", F.concat(state["out"], F.array(full))).otherwise(state["out"])
        begin = F.when(F.length(state["now"]) > overlap, F.substring(state["now"], -overlap, overlap)).otherwise(state["now"])
        return F.struct(F.when(fits, state["out"]).otherwise(grown).alias("out"), F.when(fits, F.concat(state["now"], sentence, F.lit(" "))).otherwise(F.concat(begin, sentence, F.lit(" "))).alias("now"))

    def finish(state):
        last = F.trim(state["now"])
        return F.filter(F.when(last != "", F.concat(state["out"], F.array(last))).otherwise(state["out"]), lambda c: F.length(c) > least)

    return F.aggregate(sentences, start, add, finish)


def markup(documents: DataFrame) -> DataFrame:
    """doc_id and numbers of headings, formulas, links, references, lists, comments and addresses."""
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias
    return documents.filter("text IS NOT NULL").select(
        "doc_id", n(r"(?m)^=+[^=\n]+=+ *\r?$")("headings"), n(r"<math[^>]*>[^<]*</math>")("formulas"), n(r"\[\[[^\]]*\]\]")("links"),
        n(r"<ref[^>]*>[^<]*</ref>")("refs"), n(r"(?m)^[*•] ")("items"), n(r"<!--")("comments"), n(r"https?://[^ ]+")("addresses"),
        n(r"<chem[^>]*>[^<]*</chem>")("reactions"), n(r"<sub>[^<]*</sub>")("subs"), n(r"<sup>[^<]*</sup>")("sups"), F.length("text").alias("chars"),
    )


def formula_class(text: Column) -> Column:
    """The first of seven rules that a formula's text, its tags included, meets; their order matters."""
    t = F.lower(text)
    has = lambda *w: F.greatest(*[t.contains(x) for x in w]) if len(w) > 1 else t.contains(w[0])
    every = lambda *w: F.least(*[t.contains(x) for x in w])
    return (
        F.when(every("\\langle", "\\hat{a}", "\\psi"), "hermitian_operator")
        .when(every("f(x)=", "\\sigma", "\\sqrt{2\\pi}", "\\exp"), "gaussian_normal")
        .when(has("\\frac{-b \\pm \\sqrt{b^2 - 4ac}}{2a}"), "quadratic_formula")
        .when(t.startswith("<math>") & every("\\delta =", "b^2 - 4ac"), "discriminant")
        .when(has("\\exp", "e^{", "\\sigma", "\\sqrt", "\\frac"), "algebraic_expression")
        .when(t.startswith("<chem>") | has("\\ce{"), "reaction_representation")
        .when(has("\\hbar", "\\nabla", "\\partial"), "hamiltonian").otherwise("unclassified")
    )


def formulas(documents: DataFrame) -> DataFrame:
    """doc_id, place, formula, class: every formula of every text."""
    found = F.regexp_extract_all("text", F.lit(r"<(?:math|chem)[^>]*>[^<]*</(?:math|chem)>"), F.lit(0))
    return documents.select("doc_id", F.posexplode(found).alias("place", "formula")).withColumn("class", formula_class(F.col("formula")))


def domains(documents: DataFrame) -> DataFrame:
    """doc_id, domain: every domain whose words a text has, else ``uncategorized``."""
    t = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w)), F.lit(d)) for d, words in DOMAINS.items()]))
    return documents.filter("text IS NOT NULL").select("doc_id", F.explode(F.when(F.size(hits) == 0, F.array(F.lit("uncategorized"))).otherwise(hits)).alias("domain"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The list ``related_skills`` of a text's front matter, and the text after it."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    names = F.regexp_extract(head, r"(?m)^related_skills: *\[(.*)\]", 1)
    parts = F.filter(F.transform(F.split(names, ","), lambda s: F.trim(F.translate(s, "'\"", ""))), lambda s: s != "")
    return parts, F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")
