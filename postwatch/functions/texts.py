"""Text, HTML and keyword functions over whole columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .core import any_of, col, let, lookup, text_or_blank
from .urls import host_of, last_segment, path_of

# Words that mark a career page.
CAREER_KEYWORDS = (
    "career", "careers", "job", "jobs", "vacancy", "vacancies", "opening", "openings", "hiring",
    "we-are-hiring", "work-with-us", "join-us", "join-our-team", "opportunities", "recruitment",
    "employment",
)

# Words that mark a page as something else.
NOISE_WORDS = (
    "blog", "news", "press", "investor", "privacy", "terms", "cookie", "login", "signin",
    "signup", "cart", "checkout", "support", "help", "case-study", "webinar", "event", "podcast",
    "glossary", "pricing", "template", "templates", "resources", "library", "examples",
)

# Phrases that state there is no opening.
NO_OPENING_PATTERNS = (
    r"\bno\s+(?:current\s+)?open(?:ing|ings| positions| roles| role)?\b(?!.*(?:apply|see list))",
    r"\bno\s+(?:open\s+)?(?:positions|roles|vacancies)\b",
    r"\bnothing available\b",
    r"\bnot currently hiring\b",
    r"\bno\s+job\s+opportunities\b",
    r"\bno\s+(?:open\s+)?recruitments?\b",
)

# Words in a link text that suggest a posting.
POSTING_LINK_WORDS = ("apply", "position", "job", "requisition", "see details", "view role")
POSTING_PATH_MARKS = ("/job/", "/jobs/", "/position/", "/vacancy", "/opening", "/apply/")

# Employment types of two feed dialects.
ASHBY_JOB_TYPES = {
    "FullTime": "full_time", "PartTime": "part_time", "Contract": "contract",
    "Internship": "internship", "Temporary": "temporary", "Freelance": "freelance",
}
LEVER_JOB_TYPES = {
    "fulltime": "full_time", "parttime": "part_time", "contract": "contract",
    "internship": "internship", "intern": "internship", "temporary": "temporary",
    "freelance": "freelance",
}


def squeeze(value: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^ | $", "")


def title_normalized(title: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(col(title)), r"(?U)[^\p{L}\p{N}_\s]+", "")
    return F.regexp_replace(kept, r"(?U)^\s+|\s+$", "")


def content_hash(title: Column, location: Column, description: Column) -> Column:
    parts = [text_or_blank(part) for part in (title, location, description)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def clamp_confidence(value: Column | str) -> Column:
    number = F.coalesce(col(value).cast("string").try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), number))


#: Texts folded before the next are taken.
FOLD_ROWS = 256


def _folded(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@F.arrow_udf(StringType())
def fold_ascii(text: pa.Array) -> pa.Array:
    """Accents dropped, other non-ASCII removed; Spark has no such built-in. Few texts of a batch
    are Python objects at a time."""
    return pa.concat_arrays([pa.array([], pa.string())] + [
        pa.array([_folded(t) for t in text.slice(at, FOLD_ROWS).to_pylist()], pa.string())
        for at in range(0, len(text), FOLD_ROWS)])


def slugify(value: Column | str, fold: bool = True) -> Column:
    """Lower-case words joined by single hyphens. ``fold=False`` stays in generated code and is
    right for ASCII text."""
    text = fold_ascii(col(value)) if fold else F.regexp_replace(col(value), r"[^\x00-\x7F]", "")
    kept = F.regexp_replace(F.lower(text), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def job_slug(
    title: Column, company: Column, city: Column, job_id: Column, fold: bool = True
) -> Column:
    text = F.concat_ws("-", *[text_or_blank(part) for part in (title, company, city)])
    return F.concat(
        F.substring(slugify(text, fold), 1, 311), F.lit("-"),
        F.substring(job_id.cast("string"), 1, 8),
    )


def strip_html(html: Column | str, drop_scripts: bool = True) -> Column:
    """Tags removed without leaving a blank, then white space squeezed."""
    text = text_or_blank(col(html))
    if drop_scripts:
        text = F.regexp_replace(text, r"(?is)<script.*?</script>", "")
        text = F.regexp_replace(text, r"(?is)<style.*?</style>", "")
    return squeeze(F.regexp_replace(text, r"<[^>]+>", ""))


def visible_text(html: Column | str) -> Column:
    text = F.regexp_replace(
        text_or_blank(col(html)), r"(?is)<script.*?</script>|<style.*?</style>", " "
    )
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def page_title(html: Column | str) -> Column:
    """Text of the title tag, else the og:title value."""
    text = text_or_blank(col(html))
    title = _strip(
        F.regexp_replace(
            F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", ""
        )
    )
    og = _strip(
        F.regexp_extract(
            text, r"(?i)<meta[^>]+property=['\"]og:title['\"][^>]*content=['\"]([^'\"]+)['\"]", 1
        )
    )
    return F.when(title != "", title).otherwise(og)


def no_openings(html: Column | str) -> Column:
    return let(
        F.lower(visible_text(html)),
        lambda text: any_of([text.rlike(pattern) for pattern in NO_OPENING_PATTERNS]),
    )


def path_has_keyword(path: Column | str, words: Iterable[str] = CAREER_KEYWORDS) -> Column:
    """A component between ``/``, ``-`` and ``_`` starts with one of the words. Words that hold
    a hyphen can never start a component, so they are left out."""
    single = "|".join(word for word in words if "-" not in word)
    return col(path).rlike(rf"(?i)(?:^|[/_-])(?:{single})")


def text_has_keyword(text: Column | str, words: Iterable[str] = CAREER_KEYWORDS) -> Column:
    pattern = rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"
    lowered = F.lower(text_or_blank(col(text)))
    return lowered.rlike(pattern) | F.regexp_replace(lowered, r"(?U)[\s_]+", "-").rlike(pattern)


def is_job_link(url: Column | str, text: Column | str) -> Column:
    """A link that looks like one posting: rules per board host, then general ones."""
    bare = F.regexp_replace(col(url), r"(?s)#.*$", "")
    label = text_or_blank(col(text))

    def build(b: Column) -> Column:
        host, path = b["host"], b["path"]
        depth = F.size(F.filter(F.split(path, "/"), lambda part: part != ""))
        tail, lowered = b["tail"], F.lower(path)
        general = (
            tail.rlike(r"^\d+$")
            | tail.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
            | tail.rlike(r"(?i)^[0-9a-f]{32}$")
            | any_of([lowered.contains(mark) for mark in POSTING_PATH_MARKS])
            | ((label != "") & text_has_keyword(label, POSTING_LINK_WORDS))
        )
        return (
            F.when(path.contains("/req0"), True)
            .when((host == "jobs.lever.co") | host.endswith(".jobs.lever.co"),
                  path.contains("/o/"))
            .when(host.isin("boards.greenhouse.io", "job-boards.greenhouse.io"),
                  (depth >= 2) & tail.rlike(r"^\d+$|[-_]\d+$"))
            .when(host == "jobs.ashbyhq.com",
                  (depth > 0) & ((F.length(tail) >= 6) | tail.rlike(r"^\d+$")))
            .when(host.endswith("smartrecruiters.com"),
                  lowered.contains("position")
                  | (lowered.contains("career") & (F.size(F.split(path, "/")) >= 4)))
            .when(host.endswith("myworkdayjobs.com"),
                  lowered.contains("job") | lowered.contains("req"))
            .otherwise(general)
        )

    parts = F.struct(
        host_of(bare, strip_www=False).alias("host"),
        path_of(bare).alias("path"),
        last_segment(bare).alias("tail"),
    )
    return let(parts, build)


def work_mode_from_text(*values: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *[text_or_blank(value) for value in values]))
    return (
        F.when(blob.contains("hybrid"), "hybrid")
        .when(blob.rlike("remote|work from home|wfh"), "remote")
        .when(blob.rlike("onsite|on-site|in office"), "onsite")
        .otherwise("")
    )


def lever_work_mode(workplace: Column) -> Column:
    raw = F.regexp_replace(F.lower(F.trim(text_or_blank(workplace))), "-", "")
    return F.when(raw.isin("remote", "hybrid", "onsite"), raw).otherwise("")


def job_type(value: Column, dialect: str) -> Column:
    if dialect == "ashby":
        return lookup(value, ASHBY_JOB_TYPES, F.lit(""))
    raw = F.regexp_replace(F.lower(F.trim(text_or_blank(value))), "[- ]", "")
    return lookup(raw, LEVER_JOB_TYPES, F.lit(""))


def location_text(city: Column, region: Column, country: Column, remote: Column) -> Column:
    parts = F.array(*[text_or_blank(part) for part in (city, region, country)])
    place = F.array_join(F.filter(parts, lambda part: part != ""), ", ")
    is_remote = F.coalesce(remote, F.lit(False))
    return (
        F.when(~is_remote, place).when(place == "", "Remote")
        .otherwise(F.concat(place, F.lit(" (Remote)")))
    )


def render_reasons(html: Column, anchor_count: Column) -> Column:
    """Why a page looks rendered by script: few links, little text, an empty app root."""
    length = F.length(visible_text(html))
    root = html.rlike(r"<div id=\"root\">|<div id=\"app\">|<app-root")
    return F.concat_ws(
        "; ",
        F.when(anchor_count < 5, F.format_string("only %d anchors", anchor_count)),
        F.when(length < 500, F.format_string("visible text %d chars", length)),
        F.when(root & (anchor_count == 0), F.lit("SPA root marker with no anchors")),
    )


def register_sql_functions(spark) -> None:
    """The text rules that have a pure SQL body, as temporary SQL functions."""
    words = "|".join(word for word in CAREER_KEYWORDS if "-" not in word)
    bodies = {
        "pw_title_normalized(t STRING)": (
            r"trim(regexp_replace(lower(t), '(?U)[^\\p{L}\\p{N}_\\s]+', ''))"
        ),
        "pw_content_hash(t STRING, l STRING, d STRING)": (
            "sha2(concat_ws(chr(31), coalesce(t,''), coalesce(l,''), coalesce(d,'')), 256)"
        ),
        "pw_path_has_career_word(p STRING)": f"p RLIKE '(?i)(?:^|[/_-])(?:{words})'",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow batches that hold rows."""
    return (frame for frame in frames if len(frame))
