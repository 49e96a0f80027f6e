"""Bibliographic hints by rule from the first lines of a paper: title, authors, keywords, abstract, venue, year."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: What opens an abstract and a line of keywords, what parts names and keywords, what a name looks like, and words of an affiliation and of a venue.
ABSTRACT_LINE = r"(?i)^\s*(?:abstract|摘要)(?U)\b"
ABSTRACT = r"(?is)(?:^|\n)\s*(?:abstract|摘要)\s*[:：]?\s*(.+?)(?=(?:\n\s*(?:keywords?|keyword|关键词)\s*[:：]?)|\z)"
KEYWORDS_LINE = r"(?i)^\s*(?:keywords?|keyword|关键词)\s*[:：]?"
BETWEEN_NAMES = r"\s*(?:,|，|、|;|；| and | AND )\s*"
BETWEEN_KEYWORDS = r"\s*(?:,|，|、|;|；|/|\|)\s*"
ENGLISH_NAME, CHINESE_NAME = r"[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){0,3}", "[一-鿿]{2,4}"
AFFILIATION = ("university", "college", "school", "department", "institute", "laboratory", "lab", "academy", "correspondence", "research center", "email", "工程", "学院", "大学", "研究所", "实验室", "通信作者", "作者单位")
VENUE = ("journal", "transactions", "proceedings", "conference", "symposium", "letters", "ieee", "acm", "springer", "elsevier", "arxiv", "学报", "期刊", "会议", "大学学报", "交通运输", "铁道")
TITLE_LINES, VENUE_LINES, NAME_LINES, LONGEST_NAME, LONGEST_LINE = 10, 40, 8, 80, 120


def first_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines that are not blank, collapsed.  Only the head of a text is read, unless it has too few such lines; no line is collapsed that is not wanted."""
    head = F.substring_index(text, "\n", 4 * n)
    held = lambda c: F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(tx.VISIBLE)), 1, n)
    # an array of one, so that the lines of the head are cut once
    chosen = F.transform(F.array(held(head)), lambda x: F.when((F.size(x) >= n) | (F.length(head) == F.length(text)), x).otherwise(held(text)))
    return F.transform(F.get(chosen, F.lit(0)), tx.collapse)


def holds_any(line: Column, words: tuple) -> Column:
    """Whether a line holds one of the words, which are in lower case, whatever its own case."""
    return F.exists(F.array(F.lower(line)), lambda low: reduce(or_, (low.contains(w) for w in words)))


def is_person(name: Column) -> Column:
    """Whether a text looks like a person's name: short, no affiliation, address or digit, and shaped like one."""
    shaped = name.rlike(f"^(?:{ENGLISH_NAME}|{CHINESE_NAME})$")
    return (F.length(name) <= LONGEST_NAME) & ~holds_any(name, AFFILIATION) & ~name.contains("@") & ~F.lower(name).contains("http") & ~name.rlike(r"\p{Nd}") & shaped


def names_in(line: Column) -> Column:
    """The names of a line: what marks part, else two or more names that follow each other, else Chinese ones on a short line."""
    plain = tx.collapse(F.regexp_replace(line, r"[*†‡§]+|\b\d+\b", " "))
    people = lambda parts: F.array_distinct(F.filter(F.transform(parts, tx.clean_person), is_person))
    parted = people(F.split(plain, BETWEEN_NAMES))
    english, chinese = (people(F.regexp_extract_all(plain, F.lit(p), 0)) for p in (ENGLISH_NAME, CHINESE_NAME))
    return (
        F.when(plain.rlike(",|，|、|;|；| and | AND ") & (F.size(parted) > 0), parted)
        .when(F.size(english) >= 2, english)
        .when(F.size(chinese).between(1, 10) & (F.length(plain) <= 40), chinese)
        .otherwise(F.array().cast("array<string>"))
    )


def title_of(lines: Column) -> Column:
    """The longest of the first lines that may be a title, the first of equals."""
    apart = lambda s: s.rlike(ABSTRACT_LINE) | s.rlike(KEYWORDS_LINE) | s.contains("@") | holds_any(s, ("doi", "http://", "https://", *AFFILIATION))
    fit = F.filter(F.slice(lines, 1, TITLE_LINES), lambda s: (F.length(s) >= 8) & ~apart(s))
    return F.coalesce(F.array_max(F.transform(fit, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"], F.lit(""))


def authors_of(lines: Column) -> Column:
    """The names of the first line between title and abstract that holds one to ten of them."""
    marks = F.transform(lines, lambda s: s.rlike(ABSTRACT_LINE))
    end = F.when(F.array_contains(marks, True), F.array_position(marks, True) - 1).otherwise(F.least(F.size(lines), F.lit(12)))
    window = F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.least(end - 1, F.lit(NAME_LINES))).cast("int"))
    fit = F.filter(window, lambda s: (F.length(s) <= LONGEST_LINE) & ~s.contains("@") & ~holds_any(s, AFFILIATION) & ~s.rlike(tx.YEAR))
    found = F.filter(F.transform(fit, names_in), lambda n: F.size(n).between(1, 10))
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def keywords_of(lines: Column, most: int = 10) -> Column:
    """What follows the mark of keywords on its line, or the line below where nothing does."""
    bare = lambda s: F.trim(s, F.lit(" :："))

    def after(line: Column, i: Column) -> Column:
        below = F.get(lines, i + 1)
        own = bare(F.regexp_replace(line, KEYWORDS_LINE, ""))
        return F.when(line.rlike(KEYWORDS_LINE), F.when(own != "", own).when(below.isNotNull() & ~below.rlike(ABSTRACT_LINE), bare(below)).otherwise("")).otherwise("")

    first = F.coalesce(F.get(F.filter(F.transform(lines, after), lambda s: s != ""), F.lit(0)), F.lit(""))
    parts = F.filter(F.transform(F.split(first, BETWEEN_KEYWORDS), lambda s: F.trim(tx.collapse(s), F.lit(" ,;，；"))), lambda s: s != "")
    return tx.distinct_ignoring_case(parts, most)


def abstract_of(text: Column, most: int = 3000) -> Column:
    return F.substring(tx.collapse(F.regexp_extract(F.coalesce(text, F.lit("")), ABSTRACT, 1)), 1, most)


def venue_of(lines: Column, most: int = 240) -> Column:
    return F.substring(F.coalesce(F.get(F.filter(lines, lambda s: holds_any(s, VENUE)), F.lit(0)), F.lit("")), 1, most)


def with_hints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and title, authors, keywords, abstract, venue; what is not found is empty.

    Lines are normalised once; keywords may stand anywhere, all else in the first lines.
    """
    told = docs.withColumns({"head_": first_lines(F.col(text), VENUE_LINES), "lines_": tx.clean_lines(F.col(text))})
    hints = {"title": title_of(F.col("head_")), "authors": authors_of(F.col("head_")), "keywords": keywords_of(F.col("lines_")), "abstract": abstract_of(F.col(text)), "venue": venue_of(F.col("head_"))}
    return told.withColumns(hints).drop("head_", "lines_")
