"""The explainable score: nine weighted signals, reasons, gaps and a priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape.config import Profile, Taxonomy
from rolescape.functions.dates import iso, since
from rolescape.functions.text import contains_any, first_filled, join_filled, text
from rolescape.operators.matching import enrich, searchable


def priority(score: Column, thresholds: dict[str, int]) -> Column:
    return F.when(score >= thresholds["critical"], "critical").when(score >= thresholds["high"], "high").when(score >= thresholds["normal"], "normal").otherwise("low")


def score(jobs: DataFrame, profile: Profile, as_of: Column, taxonomy: Taxonomy | None = None) -> DataFrame:
    """jobs with match_score, match_reasons, gaps and priority; with a taxonomy they are enriched first.

    Terms are substrings of the lower-cased searchable text. A score is cut at 100. Reasons and gaps are joined by "; ".
    """
    df = enrich(jobs, taxonomy) if taxonomy else jobs
    df = df.withColumn("_text", searchable(df))
    hit = {k: contains_any(F.col("_text"), v) for k, v in profile.terms.items()}
    recent = since(iso(df["published_at"]), as_of, profile.recent_days)
    degree = ~hit["diploma_eligible"] & hit["mandatory_degree"]
    where = first_filled(join_filled([df["city"], df["country"]], ", "), df["location"])
    signals = [
        ("target_role", hit["target_role"], F.concat(F.lit("Target role alignment: "), first_filled(df["normalized_role"], df["title"]))),
        ("e3d_pdms", hit["e3d_pdms"], F.lit("AVEVA E3D, PDMS, SP3D or related 3D requirement detected")),
        ("piping_layout", hit["piping_layout"], F.lit("Piping, equipment or plant-layout scope detected")),
        ("sector", hit["sector"], F.concat(F.lit("Relevant sector detected: "), first_filled(df["sector"], F.lit("EPC process industry")))),
        ("experience", hit["experience"], F.lit("Senior or lead experience level appears compatible")),
        ("preferred_location", hit["preferred_location"], F.concat(F.lit("Preferred location detected: "), where)),
        ("site_offshore", hit["site_offshore"], F.lit("Site, field, brownfield or offshore experience valued")),
        ("diploma_eligible", hit["diploma_eligible"], F.lit("Diploma eligibility stated")),
        ("recent_posting", recent, F.lit("Recently published")),
    ]
    total = sum((F.when(s, profile.weights[k]).otherwise(0) for k, s, _ in signals), F.lit(0))
    reasons = F.array_join(F.array(*[F.when(s, r) for _, s, r in signals]), "; ")
    gaps = F.array_join(F.array(F.when(~hit["target_role"], "Target role wording not detected"), F.when(~hit["e3d_pdms"], "E3D/PDMS/SP3D requirement not stated"), F.when(degree, "Degree may be mandatory")), "; ")
    df = df.withColumns({"match_score": F.least(total, F.lit(100)).cast("int"), "match_reasons": reasons, "gaps": gaps})
    return df.withColumn("priority", priority(F.col("match_score"), profile.thresholds)).drop("_text")


def profile_filter(jobs: DataFrame, minimum: int = 20) -> DataFrame:
    """Rows with a role or at least the minimum score."""
    return jobs.where((text(jobs["normalized_role"]) != "") | (jobs["match_score"] >= minimum))


def prepare(jobs: DataFrame, source_name: str, profile: Profile, as_of: Column, taxonomy: Taxonomy | None = None) -> DataFrame:
    """A source's rows named after it where they have no name, enriched and scored."""
    return score(jobs.withColumn("source_name", first_filled(jobs["source_name"], F.lit(source_name))), profile, as_of, taxonomy)
