"""Reference data. All lists are fixed values of the domain: their order is their priority."""

from __future__ import annotations

# Skills and the words that name them.
SKILLS: dict[str, list[str]] = {
    "Python": ["python", "pandas", "polars", "pyspark"],
    "SQL": ["sql", "t-sql", "pl/sql", "requetes sql", "requetage"],
    "R": ["langage r", "r"],
    "Scala": ["scala"],
    "Java": ["java"],
    "Bash": ["bash", "shell scripting"],
    "Snowflake": ["snowflake"],
    "BigQuery": ["bigquery", "big query"],
    "Redshift": ["redshift"],
    "Databricks": ["databricks", "delta lake", "lakehouse"],
    "PostgreSQL": ["postgres", "postgresql"],
    "MySQL": ["mysql", "mariadb"],
    "MongoDB": ["mongodb", "mongo"],
    "ClickHouse": ["clickhouse"],
    "Oracle": ["oracle", "exadata"],
    "SQL Server": ["sql server", "ssms", "ssis", "ssas"],
    "dbt": ["dbt", "data build tool"],
    "Airflow": ["airflow", "mwaa", "composer"],
    "Dagster": ["dagster"],
    "Prefect": ["prefect"],
    "Talend": ["talend"],
    "Dataiku": ["dataiku", "dataiku dss", "dss"],
    "Informatica": ["informatica"],
    "Azure Data Factory": ["data factory", "adf"],
    "Fivetran": ["fivetran"],
    "Airbyte": ["airbyte"],
    "Spark": ["spark", "pyspark", "databricks runtime"],
    "Kafka": ["kafka", "confluent"],
    "Flink": ["flink"],
    "Hadoop": ["hadoop", "hdfs", "hive"],
    "AWS": ["aws", "amazon web services", "s3", "glue", "lambda", "athena"],
    "GCP": ["gcp", "google cloud"],
    "Azure": ["azure", "synapse", "microsoft fabric"],
    "Terraform": ["terraform", "iac"],
    "Docker": ["docker", "conteneur"],
    "Kubernetes": ["kubernetes", "k8s", "helm"],
    "CI/CD": ["ci/cd", "gitlab ci", "github actions", "jenkins"],
    "Power BI": ["power bi", "powerbi", "dax"],
    "Tableau": ["tableau software", "tableau desktop"],
    "Looker": ["looker", "lookml"],
    "Qlik": ["qlik", "qlikview", "qliksense"],
    "Metabase": ["metabase"],
    "Excel": ["excel", "power query", "power pivot", "vba", "tableur"],
    "SAP BO": ["sap bi4", "sap bo", "businessobjects", "business objects", "webi", "web intelligence"],
    "Superset": ["superset"],
    "Streamlit": ["streamlit", "dash", "gradio"],
    "Machine Learning": ["machine learning", "apprentissage automatique", "scikit-learn", "sklearn", "xgboost"],
    "Deep Learning": ["deep learning", "pytorch", "tensorflow", "keras"],
    "MLOps": ["mlops", "mlflow", "kubeflow", "sagemaker", "vertex ai"],
    "NLP": ["nlp", "traitement du langage", "llm", "genai", "rag"],
    "Statistiques": ["statistique", "econometrie", "ab test", "a/b test"],
    "Data Governance": ["gouvernance", "data governance", "rgpd", "gdpr", "data catalog", "collibra", "datahub", "mdm", "master data management", "donnees de reference", "referentiel de donnees", "data steward"],
    "Data Quality": ["data quality", "qualite des donnees", "great expectations", "soda", "monte carlo", "fiabilite des donnees", "controle qualite des donnees"],
    "Data Modeling": ["modelisation", "data modeling", "kimball", "data vault", "star schema", "modele en etoile", "modele de donnees", "modeles de donnees", "data modeler", "merise", "architecture de donnees", "data architect"],
    "ETL": ["etl", "elt", "integration de donnees", "flux de donnees", "ingestion", "alimentation"],
    "Data Warehouse": ["datawarehouse", "data warehouse", "entrepot de donnees", "datamart", "data mart", "decisionnel", "sid"],
    "Data Lake": ["data lake", "datalake", "lac de donnees"],
    "Reporting": ["reporting", "tableau de bord", "dashboard", "kpi", "self-service bi", "pilotage"],
    "Data Platform": ["data platform", "plateforme data", "socle data", "data mesh", "data product"],
    "SAS": ["logiciel sas", "sas base", "sas eg"],
    "Alteryx": ["alteryx"],
    "MicroStrategy": ["microstrategy"],
    "Cloudera": ["cloudera", "hortonworks"],
    "Starburst": ["starburst", "trino", "presto"],
    "SAP BW": ["sap bw", "sap analytics", "sap hana"],
    "Agile": ["agile", "scrum", "kanban", "safe"],
}

# Skills that mark a data job.
CORE_SKILLS = [
    "Snowflake", "BigQuery", "Redshift", "Databricks", "ClickHouse", "dbt", "Airflow", "Dagster", "Prefect", "Talend", "Informatica", "Azure Data Factory", "Fivetran", "Airbyte", "Dataiku",
    "Alteryx", "Spark", "Hadoop", "Flink", "Cloudera", "Starburst", "Power BI", "Tableau", "Looker", "Qlik", "Metabase", "Superset", "MicroStrategy", "SAP BO", "SAP BW",
    "SAS", "Machine Learning", "Deep Learning", "MLOps", "NLP", "Statistiques", "R", "ETL", "Data Warehouse", "Data Lake", "Reporting", "Data Platform", "Data Governance", "Data Quality", "Data Modeling",
]

# Role families and the words that name them.
ROLES: dict[str, list[str]] = {
    "data_engineer": ["data engineer", "ingenieur data", "ingenieur donnees", "data platform", "etl developer", "pipeline"],
    "analytics_engineer": ["analytics engineer", "dbt", "modelisation analytique"],
    "data_analyst": ["data analyst", "analyste donnees", "business analyst data", "analyste decisionnel"],
    "bi_engineer": ["business intelligence", "consultant bi", "developpeur bi", "power bi", "tableau", "qlik"],
    "data_scientist": ["data scientist", "machine learning engineer", "ml engineer", "statisticien"],
    "data_architect": ["data architect", "architecte data", "architecte donnees"],
    "data_manager": ["data manager", "head of data", "chef de projet data", "product owner data", "data steward"],
}
GENERIC_ROLE = "data_generic"

# Competences that a role lets one expect.
EXPECTED: dict[str, list[str]] = {
    "data_engineer": ["SQL", "Python", "dbt", "Airflow", "Spark / PySpark", "Snowflake", "BigQuery", "Databricks", "ETL / ELT", "Azure Data Factory", "CI/CD"],
    "analytics_engineer": ["dbt", "SQL", "Modélisation dimensionnelle", "Modèle en étoile (Kimball)", "Snowflake", "BigQuery", "Qualité des données", "Git"],
    "data_analyst": ["SQL", "Power BI", "Excel (Power Query, TCD, VBA)", "Python", "Tableau", "Analyse métier", "KPI et tableaux de bord", "Self-service BI"],
    "bi_engineer": ["Power BI", "DAX", "Power Query (langage M)", "SQL", "Tableau", "Modèle en étoile (Kimball)", "Modèle sémantique", "SAP BusinessObjects (BI4)"],
    "data_scientist": ["Python", "Scikit-learn", "Statistiques appliquées", "SQL", "XGBoost", "Séries temporelles", "MLflow", "MLOps", "Clustering", "Modèles de scoring"],
    "data_architect": ["Modèle en étoile (Kimball)", "Modélisation dimensionnelle", "Data Vault", "Gouvernance des données", "Snowflake", "Azure", "Data lineage", "Dictionnaire de données"],
    "data_manager": ["Gouvernance des données", "Qualité des données", "Analyse métier", "MDM / données de référence", "Cadrage du besoin", "Agile / Scrum", "Gestion de projet", "Documentation technique"],
}

# Words that tell the contract, by falling priority.
CONTRACT_HINTS: dict[str, list[str]] = {
    "stage": ["stage", "internship", "stagiaire"],
    "alternance": ["alternance", "apprentissage", "apprenti", "contrat pro"],
    "freelance": ["freelance", "free-lance", "independant", "independent contractor", "contractor", "mission", "portage", "prestataire", "consultant externe", "sous-traitance"],
    "cdd": ["cdd", "fixed-term", "interim"],
    "cdi": ["cdi", "permanent", "full-time employee", "temps plein"],
}
CONTRACT_ALIASES = {"freelance": "freelance", "contractor": "freelance", "independant": "freelance", "mission": "freelance", "portage": "freelance", "cdi": "cdi", "cdd": "cdd"}
DESCRIPTION_EXCLUDES = ["stage", "alternance", "apprentissage"]

# Words that tell the remote policy.
FULL_REMOTE = ["full remote", "100% remote", "fully remote", "remote only", "teletravail total", "100% teletravail", "anywhere", "worldwide"]
HYBRID = ["hybride", "hybrid", "teletravail partiel", "remote partiel"]
ONSITE = ["sur site", "on-site", "onsite", "presentiel", "no remote", "pas de teletravail"]
REMOTE_WORD = ["remote", "teletravail", "distanciel", "a distance"]
URGENT = ["asap", "des que possible", "immediat", "immédiat", "urgent"]

# Other names of competences in offers.
ALIASES: dict[str, list[str]] = {
    "Power BI": ["powerbi", "power-bi"],
    "Excel (Power Query, TCD, VBA)": ["excel", "tableau croise"],
    "SAP BusinessObjects (BI4)": ["business objects", "businessobjects", "bo", "webi"],
    "Power Query (langage M)": ["power query", "langage m"],
    "Modèle en étoile (Kimball)": ["etoile", "kimball", "star schema", "dimensionnel"],
    "Modèle sémantique": ["semantique", "modele de donnees", "dataset"],
    "Mesures et KPI (DAX)": ["dax", "mesure", "kpi"],
    "Spark / PySpark": ["spark", "pyspark"],
    "ETL / ELT": ["etl", "elt"],
    "Matplotlib / Seaborn": ["matplotlib", "seaborn"],
    "Zapier / Make": ["zapier", "make.com"],
    "Microsoft Fabric": ["microsoft fabric", "ms fabric"],
    "Conformité et contrôle interne": ["conformite", "compliance", "controle interne", "audit interne"],
    "Gestion des risques": ["gestion des risques", "risk management", "risque de credit", "risques financiers"],
    "Tarification / pricing": ["tarification", "pricing"],
    "Facturation et refacturation": ["facturation", "refacturation", "billing"],
    "Finance & contrôle de gestion": ["controle de gestion", "finance", "financier", "financiere", "budgetaire", "banque", "bancaire", "cib", "asset management", "comptable"],
    "Secteur public": ["secteur public", "ministere", "collectivite", "administration"],
    "Hôtellerie & tourisme": ["hotellerie", "tourisme", "hospitality"],
    "RSE / ESG": ["rse", "esg", "extra-financier", "decarbonation"],
    "Dataiku": ["dataiku", "dataiku dss"],
    "Hadoop": ["hadoop", "hdfs"],
    "Lakehouse": ["lakehouse", "lake house"],
    "Change Data Capture (CDC)": ["cdc", "change data capture"],
    "LLM (GPT, Claude)": ["llm", "gpt", "genai", "ia generative"],
    "RAG (retrieval augmented generation)": ["rag", "retrieval augmented"],
    "Bases vectorielles": ["vector", "embedding"],
    "Traitement du langage (NLP)": ["nlp", "traitement du langage"],
    "API REST": ["api rest", "rest api", "api"],
    "MDM / données de référence": ["mdm", "master data", "donnees de reference"],
    "Gouvernance des données": ["gouvernance"],
    "Qualité des données": ["qualite des donnees", "data quality"],
    "Contrôles qualité automatisés": ["controle qualite", "fiabilisation"],
    "KPI et tableaux de bord": ["kpi", "tableau de bord", "dashboard"],
    "Agile / Scrum": ["agile", "scrum"],
    "Vulgarisation auprès du métier": ["vulgaris", "pedagog", "metier", "utilisateur"],
    "Autonomie": ["autonom", "independan"],
    "Rigueur": ["rigueur", "rigoureux", "precision", "fiabilite"],
    "Esprit d'analyse": ["analyse", "analytique", "esprit critique"],
    "Esprit de synthèse": ["synthese", "restitution"],
    "Travail en équipe": ["equipe", "collaboratif", "collectif"],
    "Force de proposition": ["force de proposition", "proactif", "initiative"],
    "Pédagogie et formation": ["formation", "former", "accompagnement", "montee en competence"],
    "Animation d'ateliers": ["atelier", "workshop", "animation"],
    "Gestion des priorités": ["priorit", "delai", "multi-projet"],
    "Relation client": ["client", "interlocuteur", "stakeholder"],
    "Conduite du changement": ["conduite du changement", "adoption", "transformation"],
    "Résolution de problèmes": ["resolution", "probleme", "troubleshooting"],
    "Adaptabilité": ["adaptab", "polyvalen", "flexib"],
    "Curiosité": ["curios", "veille"],
    "Communication": ["communication", "communiquer", "presentation"],
    "CI/CD": ["ci/cd", "cicd", "integration continue"],
    "Séries temporelles": ["serie temporelle", "time series", "forecast"],
    "Tests A/B": ["ab test", "a/b test"],
    "Statistiques appliquées": ["statistique", "econometrie"],
    "Prévision / forecast": ["prevision", "forecast", "budget"],
    "Self-service BI": ["self service", "self-service"],
    "Azure Data Factory": ["data factory", "adf"],
    "Apache NiFi": ["nifi"],
    "Looker Studio": ["looker studio", "data studio"],
    "Amazon SageMaker": ["sagemaker"],
    "Vertex AI": ["vertex"],
}

# What an interview asks beyond what the offer cites.
ADJACENT: dict[str, list[str]] = {
    "Power BI": ["DAX", "Power Query (langage M)", "Modèle en étoile (Kimball)"],
    "Tableau": ["SQL"],
    "Excel (Power Query, TCD, VBA)": ["Power Query (langage M)"],
    "DAX": ["Modèle en étoile (Kimball)"],
    "dbt": ["SQL", "Modèle en étoile (Kimball)"],
    "Airflow": ["Python"],
    "Snowflake": ["SQL"],
    "BigQuery": ["SQL"],
    "PostgreSQL": ["SQL"],
    "Databricks": ["Spark / PySpark"],
    "Spark / PySpark": ["Python"],
    "Scikit-learn": ["Python", "Statistiques appliquées"],
    "MLOps": ["Docker", "CI/CD"],
    "Séries temporelles": ["Statistiques appliquées"],
    "RAG (retrieval augmented generation)": ["LLM (GPT, Claude)", "Python"],
    "KPI et tableaux de bord": ["Analyse métier"],
    "Prévision / forecast": ["Statistiques appliquées"],
    "Qualité des données": ["SQL"],
}

# Lookup data of this repository; a user supplies their own questions and revision points as tables of this shape.
QUESTIONS: dict[str, list[str]] = {
    "SQL": ["Latest order of every customer?", "Why is this query slow?"],
    "Python": ["How do you test a data job?"],
    "DAX": ["Measure or computed column?"],
    "Power BI": ["How do you lay out a new model?", "How do you speed up a slow report?"],
    "Modèle en étoile (Kimball)": ["What is the grain of a fact table?"],
    "dbt": ["When do you make a model incremental?"],
    "Airflow": ["What if a task runs twice?"],
}
REVISION_TOPICS = ["SQL", "Python", "DAX", "Power BI", "Power Query (langage M)", "Modèle en étoile (Kimball)", "Snowflake", "dbt", "Airflow", "Kafka", "Docker", "Java"]

# 11 contract codes, employment types and job types of the sources.
CONTRACT_CODES = {"LIB": "freelance", "CCE": "freelance", "FRA": "freelance", "REP": "freelance", "CDI": "cdi", "DDI": "cdi", "DIN": "cdi", "CDD": "cdd", "MIS": "cdd", "SAI": "cdd", "TTI": "cdd"}
EMPLOYMENT_TYPES = {"CONTRACTOR": "freelance", "CONTRACT": "freelance", "TEMPORARY": "cdd", "FULL_TIME": "cdi", "PART_TIME": "cdi", "INTERN": "stage", "INTERNSHIP": "stage", "APPRENTICESHIP": "alternance"}
JOB_TYPES = {"contract": "freelance", "freelance": "freelance", "full_time": "cdi", "part_time": "cdi", "internship": "stage", "temporary": "cdd"}
WORK_PREFERENCES = {"full_remote": ["REMOTE", "FULL_REMOTE"], "hybrid": ["HYBRID"], "onsite": ["ON_SITE", "ONSITE"]}
AGE_BUCKETS = [1, 3, 7, 14, 31]
TRACKING = ["utm_medium", "utm_source", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "referrer"]

STATUSES = ["new", "drafted", "sent", "replied", "interview", "won", "rejected", "archived"]
