"""Fixed values of the job-text domain.

Everything in this module is data that must equal the behaviour being
reproduced (skill names and spellings, title taxonomy, level rules, stop
words, limits).  It is kept as plain literals, in natural order, so that
it can be read and reviewed as a table.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must stay equal to the reproduced behaviour.
# ---------------------------------------------------------------------------

# Skill dictionary: display name -> spellings searched for (lower case).
# Output order of extracted skills is the order of this dictionary.
SKILLS_DICTIONARY: dict[str, list[str]] = {
    "Python": ["python"],
    "Go": ["go", "golang"],
    "Java": ["java"],
    "JavaScript": ["javascript", "js"],
    "TypeScript": ["typescript", "ts"],
    "C++": ["c++", "cpp"],
    "C#": ["c#", "csharp"],
    "SQL": ["sql"],
    "FastAPI": ["fastapi"],
    "Django": ["django"],
    "Flask": ["flask"],
    "React": ["react", "react.js", "reactjs"],
    "Vue": ["vue", "vue.js", "vuejs"],
    "Angular": ["angular"],
    "Node.js": ["node.js", "node js", "nodejs", "node"],
    "PostgreSQL": ["postgresql", "postgres"],
    "MySQL": ["mysql"],
    "MongoDB": ["mongodb", "mongo"],
    "Redis": ["redis"],
    "Kafka": ["kafka"],
    "RabbitMQ": ["rabbitmq"],
    "Docker": ["docker"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Git": ["git"],
    "CI/CD": ["ci/cd", "ci\\cd", "cicd"],
    "Linux": ["linux"],
    "AWS": ["aws"],
    "GCP": ["gcp"],
    "Azure": ["azure"],
    "pandas": ["pandas"],
    "NumPy": ["numpy"],
    "scikit-learn": ["scikit-learn", "sklearn"],
    "PyTorch": ["pytorch", "torch"],
    "TensorFlow": ["tensorflow"],
    "Machine Learning": ["machine learning", "ml", "машинное обучение"],
    "Pydantic": ["pydantic"],
    "SQLAlchemy": ["sqlalchemy"],
    "Celery": ["celery"],
    "GraphQL": ["graphql"],
    "REST API": ["rest api", "restful", "rest"],
    "HTML": ["html"],
    "CSS": ["css"],
    "Excel": ["excel"],
    "Power BI": ["power bi", "powerbi"],
    "Tableau": ["tableau"],
    "ETL": ["etl"],
    "Airflow": ["airflow"],
    "Spark": ["spark"],
    "Hadoop": ["hadoop"],
}

# Categories and levels (enumerations of the prediction schema).
CATEGORIES: list[str] = ["backend", "frontend", "data_science", "analytics"]
LEVELS: list[str] = ["intern", "junior", "middle", "senior"]

# Normalised job title -> category.  Titles outside this table have no category.
TITLE_CATEGORY: dict[str, str] = {
    "senior software engineer": "backend",
    "database administrator (dba)": "backend",
    "devops engineer": "backend",
    "full stack developer (python,react js)": "backend",
    "ai engineer": "data_science",
    "machine learning (ml) engineer": "data_science",
    "data engineer": "data_science",
    "data science engineer": "data_science",
    "intern (generative ai engineering - 2d/3d image generation)": "data_science",
    "senior ios engineer": "frontend",
}

# Title word -> level, first matching rule wins (whole word, case-insensitive).
TITLE_LEVEL_RULES: list[tuple[str, str]] = [
    ("intern", "intern"),
    ("trainee", "intern"),
    ("senior", "senior"),
    ("lead", "senior"),
    ("principal", "senior"),
    ("head of", "senior"),
]

# Stop words removed before n-grams in the level/category trainer.
STOP_WORDS: list[str] = [
    "и", "в", "на", "с", "для", "до", "по", "из", "к", "о", "у", "за",
    "не", "что", "это", "как", "а", "но", "или", "то", "так", "же", "ли",
    "знание", "знания", "команду", "команде",
]

# Columns assembled into the training text, in this order.
RAW_TEXT_COLUMNS: list[str] = [
    "career_objective", "skills", "major_field_of_studies", "positions", "responsibilities",
]

# Limits and thresholds.
MIN_TEXT_LENGTH = 20            # curated text shorter than this is dropped
MIN_MATCHED_SCORE = 0.4         # raw rows below this matched_score are dropped
MIN_TRAIN_TEXT_LENGTH = 10      # training rows shorter than this are dropped
MIN_REQUEST_LENGTH = 10         # request text length bounds (code points)
MAX_REQUEST_LENGTH = 10_000
MAX_COMMENT_LENGTH = 1_000
RATE_LIMIT_REQUESTS = 100       # requests per window and user
RATE_LIMIT_WINDOW_SECONDS = 60
CACHE_TTL_SECONDS = 86_400
MODEL_VERSION = "v1"
MATCH_GOOD = 0.75               # explanation / UI bands
MATCH_PARTIAL = 0.45
TEST_SIZE = 0.2
SPLIT_SEED = 42
VOCAB_TRAIN = 5_000             # max_features of the trainer
VOCAB_COMPARE = 20_000          # max_features of the model comparison

# Histogram bucket bounds of the metrics library defaults (upper bounds, +Inf last).
HISTOGRAM_BOUNDS: list[float] = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]

# Explanation sentences (the match explanation is built from these).
EXPLAIN_GOOD = "Резюме хорошо подходит под вакансию."
EXPLAIN_PARTIAL = "Резюме частично подходит под вакансию."
EXPLAIN_WEAK = "Резюме слабо подходит под вакансию."
EXPLAIN_CATEGORY_SAME = "Направление резюме совпадает с направлением вакансии."
EXPLAIN_CATEGORY_DIFF = "Направление резюме отличается от направления вакансии."
EXPLAIN_LEVEL_SAME = "Уровень кандидата совпадает с уровнем вакансии."
EXPLAIN_LEVEL_DIFF = "Уровень кандидата отличается от уровня вакансии."
EXPLAIN_MATCHED = "Совпавшие навыки: "
EXPLAIN_MISSING = "Не хватает навыков: "

# Quality-report funnel step names, in pipeline order.
FUNNEL_STEPS: list[str] = [
    "duplicate_rows",
    "short_text",
    "title_outside_taxonomy",
    "low_matched_score",
    "duplicate_dataset_rows",
]
