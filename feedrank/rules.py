"""Rule sets and lookup values.

Everything in this module is a FIXED VALUE: the results depend on these exact
words, patterns and labels. Operators take them as arguments, so a caller can
replace any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# --- fixed values: topic, marker and exclusion patterns ---------------------

AI_PATTERNS = (
    r"\bai\b",
    r"\bml\b",
    r"\bnlp\b",
    r"\brag\b",
    r"\bllms?\b",
    r"\bartificial intelligence\b",
    r"\bintelig[eê]ncia artificial\b",
    r"\bmachine learning\b",
    r"\bdeep learning\b",
    r"\blarge language models?\b",
    r"\bgenerative ai\b",
    r"\bgen[- ]?ai\b",
    r"\bnatural language processing\b",
    r"\bcomputer vision\b",
    r"\bvis[aã]o computacional\b",
    r"\bdata science\b",
    r"\bdata scientist\b",
    r"\bdata engineer(?:ing)?\b",
    r"\bdata analyst\b",
    r"\bci[eê]ncia de dados\b",
    r"\bcientista de dados\b",
    r"\bengenheiro de dados\b",
    r"\btransformers?\b",
    r"\bprompt engineer(?:ing)?\b",
    r"\bmlops\b",
    r"\bai engineer(?:ing)?\b",
    r"\bresearch scientist\b",
    r"\binvestigador\b",
    r"\btech\s*&\s*ai\b",
)

SOFTWARE_PATTERNS = (
    r"\bsoftware engineer(?:ing)?\b",
    r"\bengenheiro de software\b",
    r"\bsoftware developer\b",
    r"\bdesenvolvedor de software\b",
    r"\bsystems engineer(?:ing)?\b",
    r"\bengenheiro de sistemas\b",
    r"\bbackend\b",
    r"\bback[- ]end\b",
    r"\bfull[- ]?stack\b",
    r"\bcloud engineer(?:ing)?\b",
    r"\bdevops\b",
    r"\binfrastructure\b",
    r"\bqa engineer(?:ing)?\b",
    r"\bsoftware development\b",
)

ENTRY_PATTERNS = (
    r"\bjunior\b",
    r"\bj[uú]nior\b",
    r"\bjr\.?\b",
    r"\btrainee\b",
    r"\bintern(?:ship)?\b",
    r"\best[aá]gio\b",
    r"\bestagi[aá]rio\b",
    r"\bgraduate\b",
    r"\bentry[- ]level\b",
    r"\bearly[- ]career\b",
    r"\bstudent\b",
    r"\bbolseir[oa]\b",
    r"\bbolsa\s+de\s+investiga[cç][aã]o\b",
)

EXCLUDE_PATTERNS = (
    r"\bsenior\b",
    r"\bsr\.?\b",
    r"\blead\b",
    r"\bprincipal\b",
    r"\bstaff\b",
    r"\bmid[- ]level\b",
    r"\bpleno\b",
    r"\bjr\s*/\s*pl\b",
    r"\bdirector\b",
    r"\bhead\s+of\b",
    r"\bmanager\b",
    r"\bgerente\b",
)

# Searched in the company and in the title.
BLOCKED_EMPLOYER_PATTERNS = ("deloitte",)

# --- fixed values: labels ---------------------------------------------------

CATEGORY_AI = "AI / ML"
CATEGORY_SWE = "Top-Tier Software Engineering"
SENIORITY_LABEL = "Junior / Trainee / Internship"
UNRATED = "Ver Reviews"
NO_RATING = "Sem rating"
NO_REVIEWS = "Sem reviews"
RECENT = "Recente"
MODALITY_DEFAULT = "Híbrido/Remoto"
MIN_SCORE = 3.1
RECHECK_SECONDS = 24 * 60 * 60

# --- fixed values: company names --------------------------------------------

ALIASES = {
    "philip morris": "tabaqueira",
    "philip morris international": "tabaqueira",
    "volkswagen": "volkswagen-digital-solutions",
    "volkswagen group": "volkswagen-digital-solutions",
    "santander": "santander-totta",
    "banco santander": "santander-totta",
    "innowave": "innowave-technologies",
    "innowave technologies": "innowave-technologies",
    "primeit": "prime-it",
    "prime it": "prime-it",
    "siemens": "siemens-sa",
    "bosch": "bosch-portugal",
    "bold": "bold-by-devoteam",
    "havi": "havi-portugal",
    "havi techhub": "havi-portugal",
    "mckinsey": "mckinsey-company",
    "mckinsey & company": "mckinsey-company",
    "mckinsey and company": "mckinsey-company",
    "nordea": "nordea-asset-management",
    "nordea asset management": "nordea-asset-management",
    "nordea asset management portugal": "nordea-asset-management",
}

SUFFIX_TOKENS = (
    "conclusion",
    "group",
    "services",
    "service",
    "solutions",
    "solution",
    "portugal",
    "portuguesa",
    "portugues",
    "gmbh",
    "inc",
    "llc",
    "ltd",
    "limited",
    "corporation",
    "corp",
    "operations",
    "sa",
    "s.a",
)

VARIANT_STOP_TOKENS = ("and", "the", "of")

SLUG_SUFFIXES = ("", "Portugal", "Technologies", "Solutions")

IGNORED_COMPANIES = (
    "",
    "n/a",
    "na",
    "confidencial",
    "consultar anuncio",
    "landing.jobs partner",
)

SIMILARITY_GATE = 0.45
TRUST_SIMILARITY = 0.8
CANDIDATES_PER_QUERY = 8

# --- fixed values: rating platforms -----------------------------------------

PRIMARY_PLATFORM = "Teamlyzer"
PRIMARY_HOST = "pt.teamlyzer.com"
FALLBACK_PLATFORM = "Glassdoor"
FALLBACK_HOST = "glassdoor.com"
FALLBACK_SEARCH_PREFIX = "https://www.glassdoor.com/Search/results.htm?keyword="
FALLBACK_REVIEWS = "Glassdoor Reviews"
FALLBACK_UNRATED_REVIEWS = "Pesquisa Global"

# --- fixed values: job areas, technologies, contacts -------------------------

# First area whose word list has a substring in the text wins.
AREAS = (
    ("Computer Vision", ("computer vision", "visão computacional", "image", "video")),
    ("AI & GenAI Engineering", ("nlp", "natural language", "llm", "rag", "genai", "generative ai")),
    ("Machine Learning", ("machine learning", "mlops", "deep learning")),
    ("Data & AI", ("data science", "data scientist", "data engineer")),
    ("Software & Systems Engineering",
     ("backend", "back-end", "systems", "cloud", "infrastructure", "devops")),
)
AREA_DEFAULT = "Engineering"

TECHNOLOGIES = (
    "Python", "PyTorch", "TensorFlow", "FastAPI", "Docker", "Kubernetes",
    "LangChain", "RAG", "LLMs", "AWS", "GCP", "Azure", "SQL", "CI/CD",
)

MANAGER_PHRASES = (
    "engineering manager", "software engineering manager", "ml manager",
    "machine learning manager", "ai manager", "head of ai", "head of data",
    "lead ai", "lead machine learning", "ai lead", "tech lead", "engineering lead",
)
EXECUTIVE_PHRASES = ("cto", "vp of engineering", "chief technology officer")
RECRUITER_PHRASES = (
    "technical recruiter", "tech recruiter", "talent acquisition partner",
    "engineering recruiter", "technical talent partner",
)
MANAGER_PLACES = ("portugal", "lisbon", "porto", "remote")
RECRUITER_PLACES = ("portugal", "lisbon", "porto", "emea", "remote")
TEAM_WORDS = ("hiring", "team", "lead", "building", "engineer")
GENERIC_NAME_WORDS = ("jobs", "vagas", "careers", "linkedin", "overview")
RESULTS_PER_QUERY = 3

# --- fixed values: report ----------------------------------------------------

SECTION_ONE_PLACES = ("lisbon", "lisboa", "oeiras", "albarraque")
SECTION_TWO_MODALITIES = ("remote", "remoto")
SECTION_TWO_PLACES = ("100% remote",)
SECTION_TITLES = {
    1: "Lisboa & Região (Híbrido / Presencial)",
    2: "100% Remoto (Nacional & Internacional)",
    3: "Outras Localizações em Portugal & Traineeships",
}
SOURCE_COLOURS = {
    "LinkedIn": "#0a66c2",
    "Landing.jobs": "#00b289",
    "Himalayas": "#2563eb",
    "Jobicy": "#7c3aed",
    "Arbeitnow": "#ea580c",
    "ITJobs.pt": "#0f766e",
}
SOURCE_COLOUR_DEFAULT = "#475569"
CATEGORY_BADGES = ("🤖 IA & ML", "⚡ TOP-TIER SWE")
CONFIDENCE_COLOURS = ("#16a34a", "#d97706")  # HIGH, any other
CONTACT_DEFAULTS = {
    "name": "Contact",
    "role": "Engineering Management",
    "evidence": "Lidera/recruta na área técnica correspondente.",
    "confidence": "MEDIUM",
}

WATCH_TARGETS = ("tensorops", "volkswagen", "euronext", "innowave", "siemens", "priberam")

# --- fixed values: feed texts -------------------------------------------------

MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
CITY_LADDER = (
    (("lisboa", "lisbon"), "Lisbon, Portugal"),
    (("porto",), "Porto, Portugal"),
    (("coimbra",), "Coimbra, Portugal"),
    (("braga",), "Braga, Portugal"),
    (("aveiro",), "Aveiro, Portugal"),
)

# The requests of one run, in order; the order decides which copy of a posting
# is kept. (source, query, row_limit, location)
REQUESTS = tuple(
    [("LinkedIn", q, 30, "Portugal") for q in (
        "Junior AI Engineer", "AI Engineer Trainee", "AI Trainee", "Gen AI Trainee",
        "Artificial Intelligence Trainee", "Machine Learning Trainee",
        "Junior Machine Learning Engineer", "AI Intern", "AI Internship", "NLP Junior",
        "NLP Intern", "Junior Data Scientist", "Data Science Intern",
        "Software Engineer Intern", "Software Engineering Intern",
        "Systems Engineer Intern", "Junior Software Engineer")]
    + [("LinkedIn", q, 30, "Lisbon, Portugal") for q in ("Junior AI", "Software Intern")]
    + [("ITJobs.pt", q, None, None) for q in (
        "junior", "inteligencia artificial", "machine learning", "estagio", "ai engineer", "nlp")]
    + [("Landing.jobs", q, 30, None) for q in ("ai", "machine learning", "junior software", "intern")]
    + [("Himalayas", q, 40, None) for q in (
        "Junior AI", "AI Intern", "Machine Learning Intern", "Software Engineer Intern",
        "Junior Software Engineer", "Junior Data")]
    + [("Jobicy", q, 30, None) for q in ("ai", "software engineer", "intern")]
    + [("Arbeitnow", q, 40, None) for q in ("junior machine learning", "software engineer intern")]
    + [("RemoteOK", q, 40, None) for q in ("intern", "junior")]
)


# Patterns of ratings in search results, of error pages and of a legal form.
RATING_SENTENCE = (
    r"(?iU)rating\s+(?:of\s+)?([1-5](?:[.,][0-9])?)\s+out\s+of\s+5"
    r"(?:\s+stars)?(?:[^\d]*(\d[\d,.]*[kK]?)\s+company\s+reviews)?"
)
RATING_SHORT = r"(?iU)\b([1-5](?:[.,][0-9])?)\s*(?:/5|stars|★)\b"
RATING_PAGES = r"(?i)/(?:Overview|Reviews|Jobs|Salary)/"
ERROR_PAGE = r"(?iU)erro\s*404"
LEGAL_FORM = r"(?U)\bs\.?\s*a\.?\b"

# Texts of outreach records. Names in braces are filled in.
EVIDENCE_TEXTS = {
    "area": "Cargo diretamente ligado à área da vaga ({area}).",
    "place": "Localização compatível com a posição anunciada.",
    "team": "Sinais públicos de gestão e liderança técnica na equipa.",
    "role": "Atua como {role} na empresa {company}.",
    "recruiter": "Recrutador(a) técnico(a) identificado(a) na empresa {company}.",
    "region": "Foco em recrutamento técnico na região relevante.",
}
# (proof, hook) for a fitting project, for the skills, and for neither.
CLAIM_TEXTS = {
    "retrieval": (
        "built an end-to-end RAG and semantic search pipeline using FastAPI and vector search",
        "The team's focus on {area} and modern AI architectures aligns directly with my recent hands-on RAG implementation.",
    ),
    "aggregator": (
        "developed an asynchronous data pipeline in Python with automated scraping, strict regex filtering, and CI/CD",
        "The requirements for {title} match my experience building production-ready Python pipelines "
        "and data scraping workflows.",
    ),
    "skills": (
        "implemented machine learning pipelines in Python and PyTorch with Docker deployment",
        "The technical stack for {title} directly matches my core Python and ML background.",
    ),
    "none": (
        "developed practical software and AI projects in Python with a focus on clean engineering",
        "The responsibilities described for the {title} role strongly overlap with my background.",
    ),
}
MESSAGE_TEXT = (
    "Hi {name} — I applied for the {title} position today.\n\n"
    "I saw the work your team is doing in this area. I recently {proof}, so the overlap with the vacancy "
    "stood out to me.\n\n"
    "I wanted to introduce myself directly after submitting my official application. Thanks for taking a look!"
)


@dataclass(frozen=True)
class Rules:
    """Pattern lists used by the classification operators."""

    ai: tuple[str, ...] = AI_PATTERNS
    software: tuple[str, ...] = SOFTWARE_PATTERNS
    entry: tuple[str, ...] = ENTRY_PATTERNS
    exclude: tuple[str, ...] = EXCLUDE_PATTERNS
    blocked: tuple[str, ...] = BLOCKED_EMPLOYER_PATTERNS

    def with_table(self, table: DataFrame, max_patterns: int = 10_000) -> "Rules":
        """Replace sets by the rows of a (rule_set, ordinal, pattern) table.

        Patterns become part of the plan, so the table has to be small; a
        table above ``max_patterns`` rows is refused, not cut.
        """
        rows = table.orderBy("rule_set", "ordinal").limit(max_patterns + 1).collect()
        if len(rows) > max_patterns:
            raise ValueError(f"rules table has more than {max_patterns} patterns")
        sets: dict[str, list[str]] = {}
        for row in rows:
            sets.setdefault(row["rule_set"], []).append(row["pattern"])
        return replace(self, **{name: tuple(p) for name, p in sets.items()})

    def to_table(self, spark) -> DataFrame:
        rows = [
            (name, i, pattern)
            for name in ("ai", "software", "entry", "exclude", "blocked")
            for i, pattern in enumerate(getattr(self, name))
        ]
        return spark.createDataFrame(rows, "rule_set string, ordinal int, pattern string")


DEFAULT_RULES = Rules()

