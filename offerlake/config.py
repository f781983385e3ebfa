"""Typed settings of a campaign and of a profile; they become literals and small tables, never files on executors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime


@dataclass(frozen=True)
class Config:
    keywords_any: list[str] = field(default_factory=lambda: ["data"])
    exclude_any: list[str] = field(default_factory=list)
    min_core_skills: int = 3  # without a keyword in the title
    contracts: list[str] = field(default_factory=lambda: ["freelance"])
    max_age_days: int = 30  # 0: no limit
    min_daily_rate: int = 0  # 0: no limit
    locations: list[str] = field(default_factory=list)
    locations_exclude: list[str] = field(default_factory=list)
    locations_skip_sources: list[str] = field(default_factory=list)
    remote_only: bool = False
    refresh_margin_days: int = 2
    weights: dict[str, float] = field(default_factory=lambda: {"skills_match": 45, "daily_rate": 20, "remote": 15, "freshness": 10, "duration": 10})
    apply_threshold: float = 65


@dataclass(frozen=True)
class Profile:
    skills: dict[str, list[str]]  # level (expert, advanced, familiar) -> names
    rate_target: int | None = None
    rate_floor: int | None = None
    rate_strategy: str = "align"
    remote: str = "hybrid"
    preferred_months: float = 6.0
    available_from: date | None = None
    references: list[tuple[str, str, list[str], str]] = field(default_factory=list)  # client, period, stack, achievement
    competences: dict[str, list[str]] = field(default_factory=dict)  # category -> names, both in order
    transversal: list[str] = field(default_factory=list)
    fixed: list[tuple[str, list[str]]] = field(default_factory=list)  # sections that every offer gets: label, competences
    bullets: list[tuple[str, str, int, int, int, str, bool, bool]] = field(default_factory=list)  # kind, block, block order, bullet order, variant order, text, pinned, optional


LEVEL_WEIGHTS = {"expert": 1.0, "advanced": 0.75, "familiar": 0.45}
UNWEIGHTED = 0.6  # a matched skill without a level of its own
NO_SKILLS_CAP = 50.0

# The settings of the registered queries.
AS_OF = datetime(2024, 2, 1)
CONFIG = Config(
    keywords_any=["data", "analytics", "bi"],
    exclude_any=["stage", "alternance", "data entry"],
    min_core_skills=2,
    contracts=["freelance"],
    max_age_days=30,
    min_daily_rate=400,
    locations=["paris", "remote", "france"],
    locations_exclude=["brazil", "latam"],
)
PROFILE = Profile(
    skills={"expert": ["Python", "SQL", "dbt"], "advanced": ["Snowflake", "Airflow"], "familiar": ["AWS"]},
    rate_target=650,
    rate_floor=500,
    available_from=date(2020, 1, 1),
    references=[("Client A", "2022", ["dbt", "Snowflake"], "Rebuilt the warehouse"), ("Client B", "2021", ["Power BI", "DAX"], "Reports for sales")],
    competences={
        "Langages": ["SQL", "Python", "DAX", "Java"],
        "BI": ["Power BI", "Excel (Power Query, TCD, VBA)", "KPI et tableaux de bord", "Tableau", "Power Query (langage M)"],
        "Entrepots": ["Snowflake", "BigQuery", "PostgreSQL"],
        "Orchestration": ["dbt", "Airflow", "CI/CD", "Docker"],
        "Gouvernance": ["Gouvernance des données", "Qualité des données"],
        "Streaming": ["Kafka", "Spark / PySpark", "Databricks", "ETL / ELT"],
    },
    transversal=["Autonomie", "Rigueur", "Esprit d'analyse", "Communication", "Travail en équipe"],
    fixed=[("Langues", ["Français", "Anglais"])],
    bullets=[
        ("experience", "Bank", 1, 1, 0, "Reporting Power BI et DAX", False, False),
        ("experience", "Bank", 1, 1, 1, "Pipelines Python et SQL", False, False),
        ("experience", "Bank", 1, 2, 0, "Gouvernance et qualité des données", True, False),
        ("experience", "Bank", 1, 3, 0, "Kafka et Spark en production", False, True),
        ("project", "Lake", 2, 1, 0, "Snowflake, dbt et Airflow", False, False),
        ("project", "Lake", 2, 2, 0, "Docker et CI/CD", False, True),
        ("project", "Shop", 3, 1, 0, "Excel et Power BI", False, False),
        ("project", "Shop", 3, 2, 0, "Java", False, False),
    ],
)
