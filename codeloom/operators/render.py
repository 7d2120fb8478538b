"""Reports of results as JSON, HTML and text. Only bounded numbers of rows leave Spark: totals, and the first issues of each analyzer."""

from __future__ import annotations

import html
import json
import os
from abc import ABC, abstractmethod
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEVERITIES, severity_rank
from . import findings

#: Issues of an analyzer in the HTML report, severe ones and characters of a title in the text report
SHOWN, LISTED, TITLE = 5, 10, 50


def first_issues(issues: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first n issues of each analyzer, severest first, with their snippets if the issues have any, and how many more it has."""
    ranked = issues.withColumn("rank", severity_rank(F.col("severity")))
    kept = ranked.groupBy("analyzer").agg(F.count("*").alias("n"))
    top = findings.cap(ranked.withColumn("order", F.struct("rank", "emit_seq")).drop("emit_seq").withColumnRenamed("order", "emit_seq"), "analyzer", n)
    return top.join(F.broadcast(kept), "analyzer").select("analyzer", "place", "severity", F.substring("title", 1, TITLE).alias("title"), "file_path", "line_number", *(c for c in ("snippet",) if c in top.columns), (F.col("n") - F.least("n", F.lit(n))).alias("more"))


class Reporter(ABC):
    """generate() writes a report of one row of scores, the issues and the insights of each analyzer, and returns its path."""

    def __init__(self, folder: str):
        self.folder = folder

    @abstractmethod
    def text(self, summary: dict, issues: list[dict], severities: dict[str, int], insights: dict[str, list[str]]) -> str: ...

    suffix = "txt"

    def collect(self, scores: DataFrame, issues: DataFrame, insights: DataFrame) -> tuple:
        severities = {r["severity"]: r["n"] for r in findings.by_severity(issues).collect()}
        shown = [r.asDict() for r in first_issues(issues).orderBy("analyzer", "place").collect()]
        return scores.first().asDict(), shown, severities, {r["analyzer"]: list(r["insights"]) for r in insights.collect()}

    def generate(self, scores: DataFrame, issues: DataFrame, insights: DataFrame, now: datetime | None = None) -> str:
        os.makedirs(self.folder, exist_ok=True)
        text = self.text(*self.collect(scores, issues, insights))
        name = f"report_{(now or datetime.now(UTC)).strftime('%Y%m%d_%H%M%S')}.{self.suffix}"
        for path in (name, f"latest.{self.suffix}"):
            with open(os.path.join(self.folder, path), "w", encoding="utf-8") as f:
                f.write(text)
        return os.path.join(self.folder, name)


class JsonReporter(Reporter):
    suffix = "json"

    def text(self, summary, issues, severities, insights) -> str:
        return json.dumps({"summary": summary, "severities": severities, "issues": issues, "insights": insights}, indent=2, default=str)


class TextReporter(Reporter):
    def text(self, summary, issues, severities, insights) -> str:
        total = sum(severities.values())
        out = [f"{k}: {v}" for k, v in summary.items()]
        out += [f"{s:<9}{n:>7} {100 * n / total:5.1f}% {'#' * int(100 * n / total / 2.5)}" for s, n in sorted(severities.items(), key=lambda x: SEVERITIES.index(x[0])) if total]
        severe = [i for i in issues if i["severity"] in ("critical", "high")][:LISTED]
        out += [f"{i['severity']}: {i['title']} ({':'.join(str(x) for x in (i['file_path'], i['line_number']) if x)})" for i in severe]
        return "\n".join([*out, *(f"{a}: {t}" for a, said in insights.items() for t in said[:3])]) + "\n"


class HtmlReporter(Reporter):
    suffix = "html"

    def text(self, summary, issues, severities, insights) -> str:
        cell = lambda x: f"<td>{html.escape(str(x))}</td>"
        table = lambda rows: "<table>" + "".join(f"<tr>{''.join(map(cell, r))}</tr>" for r in rows) + "</table>"
        top = max([1, *severities.values()])
        bars = "".join(f'<tr>{cell(s)}{cell(n)}<td><div style="background:#888;height:1em;width:{300 * n // top}px"></div></td></tr>' for s, n in severities.items())
        parts = ["<h1>Report</h1>", table(summary.items()), f"<h2>Severities</h2><table>{bars}</table>"]
        for a in sorted({i["analyzer"] for i in issues} | insights.keys()):
            own = [i for i in issues if i["analyzer"] == a]
            parts.append(f"<h2>{html.escape(a)}</h2>" + table((i["severity"], i["title"], i["file_path"], i["line_number"], *([i["snippet"]] if "snippet" in i else [])) for i in own))
            parts.append(f"<p>... and {own[0]['more']} more</p>" if own and own[0]["more"] else "")
            parts.append("<ul>" + "".join(f"<li>{html.escape(t)}</li>" for t in insights.get(a, [])) + "</ul>")
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>{''.join(parts)}</body></html>"


def load_report(path: str) -> dict:
    """A report that JsonReporter wrote."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
