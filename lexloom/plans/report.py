"""The gap report as text and JSON, from the tables of `operators.gaps` (a few rows a law)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import MANDATE, MATRIX
from lexloom.operators.gaps import FLAGS, coverage, deltas, matrix

RULE = "─" * 60


class Report:
    """Collects one row a law and one a gap, and formats them."""

    def __init__(self, statements: DataFrame):
        cov = coverage(statements).persist()
        try:
            self.rows = {r["law"]: r.asDict() for r in cov.orderBy("law").collect()}
            self.gaps = [r.asDict() for r in deltas(cov).orderBy("law_a", "law_b", "ord").collect()]
        finally:
            cov.unpersist()
        self.laws = list(self.rows)

    def rate(self, law: str, flag: str) -> float:
        r = self.rows[law]
        return r[flag] / r["total"] if r["total"] else 0.0

    def coverage(self, title: str, column: str) -> str:
        every = sorted({v for r in self.rows.values() for v in r[column]})
        lines = [RULE, f"{title} coverage", RULE, "Universe (all values seen across all laws):", f"  {', '.join(every) or '(none)'}", ""]
        for law, r in self.rows.items():
            lines += [f"  {law}", f"    present : {', '.join(r[column]) or '(none)'}"]
            if missing := [v for v in every if v not in r[column]]:
                lines.append(f"    absent  : {', '.join(missing)}")
        return "\n".join(lines)

    def flag(self, title: str, column: str) -> str:
        lines = [RULE, title, RULE]
        for law, r in self.rows.items():
            x = self.rate(law, column)
            full = int(x * 20)
            lines.append(f"  {law:<8} {'█' * full + '░' * (20 - full)} {x:>5.0%}  ({r[column]}/{r['total']} stmts)  [{'MANDATES' if x >= MANDATE else 'optional'}]")
        return "\n".join(lines)

    def cell(self, law: str, column: str) -> str:
        if column not in FLAGS:
            return str(len(self.rows[law][column]) or "—")
        x = self.rate(law, column)
        return "—" if x == 0 else f"{'✓' if x >= MANDATE else '·'}{x:.0%}"

    def matrix(self) -> str:
        header = f"{'Dimension':<24}" + "".join(f"{law:>10}" for law in self.laws)
        body = [f"{label:<24}" + "".join(f"{self.cell(law, column):>10}" for law in self.laws) for label, column in MATRIX]
        return "\n".join(["Coverage matrix", "=" * len(header), header, "─" * len(header), *body, "─" * len(header), "Numbers: distinct values; ✓ mandated (30 % of statements or more); · occasional; — absent"])

    def delta(self, a: str, b: str) -> str:
        lines = [RULE, f"Gap analysis: {a} vs {b}", f"(Obligations in {a} not present in {b})", RULE]
        own = [g for g in self.gaps if (g["law_a"], g["law_b"]) == (a, b)]
        for g in own:
            lines += [f"  {g['dimension']}:", *[f"    · {v}" for v in g["missing"]], *([f"    → {g['note']}"] if g["note"] else []), ""]
        return "\n".join(lines if own else [*lines, "  No significant gaps found."])

    def text(self) -> str:
        parts = ["=" * 60, "GAP ANALYSIS REPORT", "=" * 60, f"\nRepository: {sum(r['total'] for r in self.rows.values())} statements across {len(self.laws)} laws", *[f"  {law}: {r['total']} statements" for law, r in self.rows.items()]]
        parts.append("\n\n" + self.matrix())
        for title, column in (("Legal basis", "legal_basis_types"), ("Rights", "right_types"), ("Retention policy mandate", "has_retention"), ("Risk assessment mandate", "has_dpia"), ("Transfer mechanisms", "transfer_mechanisms"), ("Constraints", "constraint_types"), ("Purposes", "purpose_categories")):
            parts.append("\n\n" + (self.flag if column in FLAGS else self.coverage)(title, column))
        if len(self.laws) > 1:
            parts += ["\n\n" + RULE, "PAIRWISE GAP ANALYSIS"]
            parts += [self.delta(*p) for i, a in enumerate(self.laws) for b in self.laws[i + 1 :] for p in ((a, b), (b, a))]
        return "\n".join(parts)

    def json(self) -> str:
        """Deltas one way only, rates of the two mandates to three places."""
        value = lambda law, column: self.rate(law, column) if column in FLAGS else self.rows[law][column]
        named = {"legal_basis_coverage": "legal_basis_types", "rights_coverage": "right_types", "constraint_coverage": "constraint_types", "purpose_coverage": "purpose_categories", "transfer_coverage": "transfer_mechanisms"}
        out = {"laws": self.laws, "stats": {"total": sum(r["total"] for r in self.rows.values()), "by_law": {law: r["total"] for law, r in self.rows.items()}}}
        out |= {k: {law: value(law, c) for law in self.laws} for k, c in named.items()}
        out |= {k: {law: round(self.rate(law, c), 3) for law in self.laws} for k, c in (("retention_rates", "has_retention"), ("dpia_rates", "has_dpia"))}
        out["coverage_matrix"] = {label: {law: value(law, c) for law in self.laws} for label, c in MATRIX}
        gaps = lambda a, b: [{"dimension": g["dimension"], "missing_values": g["missing"], "note": g["note"]} for g in self.gaps if (g["law_a"], g["law_b"]) == (a, b)]
        out["pairwise_deltas"] = [{"law_a": a, "law_b": b, "gaps": gaps(a, b)} for i, a in enumerate(self.laws) for b in self.laws[i + 1 :]]
        return json.dumps(out, indent=2, ensure_ascii=False)


def report_json(statements: DataFrame) -> DataFrame:
    """The matrix as one JSON document a law, without the driver."""
    cells = matrix(coverage(statements)).groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ord", "dimension", "vals", "rate"))).alias("cells"))
    return cells.select("law", F.to_json("cells").alias("json"))
