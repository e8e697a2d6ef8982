"""HTML cleaning to a short allow-list, in Arrow batches."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags and attributes that stay.
ALLOWED_TAGS = (
    "p", "br", "strong", "em", "u", "ul", "ol", "li", "h3", "h4", "a", "code", "pre",
    "blockquote",
)
ALLOWED_LINK_ATTRIBUTES = ("href", "title", "target")
ALLOWED_SCHEMES = ("http", "https", "mailto")
LINK_REL = "nofollow noopener noreferrer"

_DROPPED_WITH_CONTENT = ("script", "style")
_SCHEME = re.compile(r"^([a-z][a-z0-9+.\-]*):", re.I)
_INVISIBLE = re.compile(r"[\x00-\x20\x7f-\xa0​-‏  ﻿]")


def _safe_address(value: str) -> bool:
    """Relative addresses and allowed schemes; hidden characters cannot disguise a scheme."""
    bare = _INVISIBLE.sub("", value)
    named = _SCHEME.match(bare)
    return named.group(1).lower() in ALLOWED_SCHEMES if named else ":" not in bare.split("/")[0]


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.skipping: str | None = None

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            return
        if tag in _DROPPED_WITH_CONTENT:
            self.skipping = tag
        elif tag in ALLOWED_TAGS:
            self.out.append(f"<{tag}{self._attributes(attrs) if tag == 'a' else ''}>")
            if tag != "br":
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in _DROPPED_WITH_CONTENT:
            self.handle_starttag(tag, attrs)

    def _attributes(self, attrs) -> str:
        kept: dict[str, str] = {}
        for name, value in attrs:
            if name in ALLOWED_LINK_ATTRIBUTES and name not in kept:
                if name != "href" or _safe_address(value or ""):
                    kept[name] = value or ""
        kept["target"] = "_blank"
        kept["rel"] = LINK_REL
        return "".join(f' {n}="{html.escape(v, quote=True)}"' for n, v in kept.items())

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping:
                self.skipping = None
        elif tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skipping:
            self.out.append(html.escape(data, quote=False))

    def result(self) -> str:
        return "".join(self.out) + "".join(f"</{tag}>" for tag in reversed(self.open))


def clean_html(text: str | None) -> str:
    """Allowed markup of one text. Whatever is not understood comes out as escaped text."""
    if not text:
        return ""
    cleaner = _Cleaner()
    cleaner.feed(text)
    cleaner.close()
    return cleaner.result()


@F.pandas_udf(StringType())
def _clean_batch(texts: pd.Series) -> pd.Series:
    return texts.map(clean_html)


def sanitize_html(column: Column | str) -> Column:
    """Cleaned markup. Texts without markup never reach Python."""
    value = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return F.when(value.rlike("[<&>]"), _clean_batch(value)).otherwise(value)
