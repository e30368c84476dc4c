"""Values every stage agrees on."""

# ---------------------------------------------------------------------------
# Results depend on them being exactly these.
# ---------------------------------------------------------------------------

LANGUAGES = {
    "en": "English",
    "de": "German",
    "fr": "French",
    "es": "Spanish",
    "hi": "Hindi",
    "zh": "Chinese (Simplified)",
}

THEMES = {
    "workload_balance": "Workload & Work-Life Balance",
    "management_leadership": "Management & Leadership Quality",
    "recognition_rewards": "Recognition & Rewards",
    "career_growth": "Career Development & Growth",
    "team_collaboration": "Team Collaboration & Culture",
    "company_strategy": "Company Strategy & Direction",
    "tools_resources": "Tools, Resources & Work Environment",
    "inclusion_belonging": "Diversity, Inclusion & Belonging",
    "wellbeing_safety": "Employee Wellbeing & Psychological Safety",
    "communication": "Internal Communication & Transparency",
}

SENTIMENTS = ["very_positive", "positive", "neutral", "negative", "very_negative"]
SENTIMENT_PERCENT = {
    "very_positive": 15,
    "positive": 35,
    "neutral": 25,
    "negative": 18,
    "very_negative": 7,
}
ACTIONS = ["urgent_action", "monitor", "positive_share", "no_action"]
RISK_LEVELS = ["low", "medium", "high", "critical"]

DEPARTMENTS = [
    "Engineering", "Product", "Finance", "HR", "Operations",
    "Sales", "Marketing", "Legal", "Customer Success", "Data & Analytics",
]
EXPERIENCE_LEVELS = ["0-1 year", "1-3 years", "3-5 years", "5-10 years", "10+ years"]

# Risk cut-offs are inclusive upper bounds; anything above the last is critical.
RISK_CUTOFFS = {"low": 0.3, "medium": 0.55, "high": 0.75}
SENTIMENT_SCORES = {
    "very_positive": 0.0,
    "positive": 0.15,
    "neutral": 0.35,
    "negative": 0.65,
    "very_negative": 1.0,
}
UNKNOWN_SENTIMENT_SCORE = 0.35
HIGH_RISK_THEMES = ["wellbeing_safety", "workload_balance", "management_leadership"]
MEDIUM_RISK_THEMES = ["recognition_rewards", "career_growth", "communication"]
BURNOUT_EMOTIONS = [
    "exhausted", "overwhelmed", "frustrated", "burned out", "stressed",
    "undervalued", "ignored", "hopeless", "anxious", "disengaged",
]
PROTECTIVE_EMOTIONS = [
    "supported", "motivated", "appreciated", "engaged", "hopeful",
    "satisfied", "valued", "energized",
]

TEXT_MIN, TEXT_MAX = 5, 5000
MSG_MISSING = "Field required"
MSG_NOT_STRING = "Input should be a valid string"
MSG_SHORT = "String should have at least 5 characters"
MSG_LONG = "String should have at most 5000 characters"
MSG_BLANK = "Value error, Survey response text cannot be blank"

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}\b"
PERSON_PATTERN = r"\b(?:Mr\.|Ms\.|Mrs\.|Dr\.|Prof\.)\s+[A-Z][a-z]+(?: [A-Z][a-z]+)?\b"
PLACEHOLDERS = {
    "EMAIL_ADDRESS": "[EMAIL]",
    "PHONE_NUMBER": "[PHONE]",
    "PERSON": "[PERSON]",
    "IBAN_CODE": "[IBAN]",
    "CREDIT_CARD": "[CREDIT_CARD]",
    "EMAIL": "[EMAIL]",
    "PHONE": "[PHONE]",
}

LABEL_DEFAULTS = {
    "sentiment": "neutral",
    "sentiment_confidence": 0.5,
    "primary_theme": "communication",
    "summary_en": "",
    "action_signal": "no_action",
    "language_detected": "en",
}
LABEL_FALLBACK = {
    "sentiment": "neutral",
    "sentiment_confidence": 0.0,
    "primary_theme": "communication",
    "summary_en": "Analysis failed.",
    "action_signal": "no_action",
    "language_detected": "unknown",
}
LABEL_CHUNK = 10
LABEL_ATTEMPTS = 3
LABEL_WAIT_SECONDS = 2

NO_TOPIC, NO_TOPIC_LABEL = -1, "N/A"
N_TOPICS = 15
MIN_TOPIC_SIZE = 10
TOPIC_KEYWORDS = 5
TOPIC_LABEL_WORDS = 3
MIN_ROWS_FOR_TOPICS = 10

RETRIEVE_K = 3
QUERY_THEMES = 3
REPORT_REFERENCES = 3
CRISIS_MEAN = 0.55
QUERY_FORMAT = "best practices for %s employee engagement"
CRISIS_QUERY = "burnout prevention and crisis intervention"
DEFAULT_KB_TOPIC = "general"

REPORTED_ERRORS = 50
GATE_ERRORS = 20
TOP_N = 5
PREVIEW_ROWS = 10

REQUEST_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
MODEL_CALL_BUCKETS = [0.5, 1.0, 2.5, 5.0, 10.0, 30.0]

SYNTH_BATCH = 5
SYNTH_PER_LANGUAGE = 500

# Seed rows of the knowledge table: (id, topic, text).
KB_SEED = [
    ("wb_001", "workload_balance",
     "Workload imbalance is the top predictor of voluntary attrition. "
     "Effective interventions: workload audits every quarter, explicit capacity planning "
     "in sprint/project cycles, and manager training on sustainable pacing."),
    ("wb_002", "workload_balance",
     "Flexible work arrangements reduce reported burnout by 23% (Gallup 2023). "
     "Async-first policies and protected focus time blocks are the highest-impact levers."),
    ("ml_001", "management_leadership",
     "Manager quality explains 70% of variance in team engagement scores. "
     "Best-in-class programs: bi-weekly 1:1s with structured templates, "
     "skip-level meetings quarterly, and 360 feedback cycles every 6 months."),
    ("rr_001", "recognition_rewards",
     "Peer recognition programs increase engagement by up to 36%. "
     "Timely recognition (within 24h) is more impactful than monetary rewards. "
     "Recommended: lightweight recognition tooling (Kudos, Lattice) embedded in daily workflow."),
    ("cg_001", "career_growth",
     "Lack of career clarity is the #2 driver of disengagement for tenured employees. "
     "Individual Development Plans (IDPs) reviewed quarterly and tied to project assignments "
     "reduce churn by 18% (LinkedIn Workforce Report)."),
    ("ws_001", "wellbeing_safety",
     "Psychological safety — the belief that one can speak up without fear of punishment — "
     "is the strongest predictor of high-performing teams (Google Project Aristotle). "
     "Establish: anonymous feedback channels, blameless post-mortems, "
     "and explicit norms around respectful disagreement."),
    ("ws_002", "wellbeing_safety",
     "Burnout crisis intervention: immediate workload relief (reassign tasks), "
     "access to EAP (Employee Assistance Program), confidential 1:1 with HR, "
     "and 2-4 week follow-up check-in. Document and escalate to senior leadership."),
    ("tc_001", "team_collaboration",
     "Distributed team cohesion is built through structured rituals: "
     "weekly async standups, monthly virtual socials, and cross-functional project pairing. "
     "Avoid over-reliance on synchronous meetings — meeting load is a top complaint."),
    ("comm_001", "communication",
     "Communication opacity (lack of strategic transparency) erodes trust faster than "
     "any other factor. Best practices: monthly all-hands with live Q&A, "
     "decision logs in a searchable wiki, and executive AMAs."),
    ("ib_001", "inclusion_belonging",
     "Belonging scores predict retention 2x better than satisfaction scores. "
     "Actionable levers: inclusive hiring panels, ERG funding, "
     "pay equity audits, and bias-free performance review calibration."),
]
