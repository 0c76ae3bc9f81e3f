"""URL filter rules indexed by their rarest literal token.

Each rule becomes a regular expression over "host path".  A rule is filed under the one
of its literal tokens that the fewest URLs have; the tokens of a URL fetch the rules
filed under them, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rules are held by every task; beyond this the caller has to split them.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    """``host`` also stands for its subdomains; ``path`` is a prefix, in which * is any text."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        path = ".*".join(re.escape(x) for x in self.path.split("*"))
        return re.compile(rf"(?:.*\.)?{re.escape(self.host)}\Z", re.DOTALL), re.compile(path, re.DOTALL)

    def tokens(self) -> set[str]:
        """Tokens that every URL under the rule has whole."""
        found = set(_TOKEN.findall(self.host))
        literal = self.path.split("*")[0].translate(_UPPER)
        cut = literal if literal[-1:] and not _TOKEN.match(literal[-1]) else re.sub(r"[a-z0-9]+$", "", literal)
        return found | set(_TOKEN.findall(cut))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def _tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host + "\n" + path.translate(_UPPER)))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens occurs; all URLs are counted."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = dict.fromkeys(tokens, 0)
        for frame in frames:
            for url in frame.url:
                for t in _tokens(*split_url(url)) & tokens:
                    found[t] += 1
        yield pd.DataFrame({"token": list(found), "n": list(found.values())})

    if not tokens:
        return {}
    rows = urls.mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one for each rule token at most
    return dict.fromkeys(tokens, 0) | {r.token: r.n for r in rows}


class RuleIndex:
    def __init__(self, rules: list[UrlRule], counts: dict[str, int]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the index holds {MAX_RULES} at most")
        self.filed: dict[str, list[tuple[int, UrlRule, re.Pattern, re.Pattern]]] = {}
        for order, rule in enumerate(rules):
            tokens = rule.tokens()
            rarest = min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""
            self.filed.setdefault(rarest, []).append((order, rule, *rule.patterns()))

    def match(self, host: str, path: str) -> UrlRule | None:
        """The longest rule that fits, the first of equally long ones."""
        best = None
        for token in ("", *_tokens(host, path)):
            for order, rule, of_host, of_path in self.filed.get(token, ()):
                rank = (len(rule.name), -order)
                if (best is None or rank > best[0]) and of_host.match(host) and of_path.match(path):
                    best = (rank, rule)
        return best[1] if best else None


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (null where none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    rule wins, ``default`` holds where none fits.  A null url, and one without "://", has an
    empty host and path.  Rows that repeat an id are judged one by one.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    counts = token_counts(urls, {t for r in rules for t in r.tokens()})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [index.match(*p) for p in parts]
            said = [[p[0] for p in parts], [p[1] for p in parts], [r.name if r else None for r in found], [r.verdict if r else default for r in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in said]], names=["page_id", "host", "path", "rule", "verdict"])

    schema = f"page_id {urls.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return urls.mapInArrow(judge, schema)
