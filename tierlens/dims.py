"""Fixed dimension tables.

Values in the FIXED VALUES blocks must equal the routing system's own
settings for results to match; they are stated plainly and in natural order.
Money is carried as BIGINT nano-USD: a rate in USD per million tokens times
1000 is nano-USD per token, exact for every rate below.
"""

from __future__ import annotations


# ---- FIXED VALUES: tiers -------------------------------------------------
# tier -> (label, model)
TIERS = [
    (1, "small", "ministral-3b-latest"),
    (2, "medium", "mistral-small-latest"),
    (3, "large", "mistral-medium-latest"),
    (4, "xlarge", "mistral-large-latest"),
]
DEFAULT_TIER_LABEL = "medium"
DEFAULT_TIER_MODEL = "mistral-small-latest"
BASELINE_TIER = 3
ROUTER_DEFAULT_MODEL = "ministral-3b-latest"
SUMMARISER_MODEL = "magistral-small-2509"
SUMMARY_INTERVAL = 5
FEEDBACK_THRESHOLD = 20

# ---- FIXED VALUES: price books, USD per million tokens (input, output) ----
PRICE_BOOKS = {
    "roi": {1: (0.1, 0.1), 2: (0.1, 0.3), 3: (0.4, 2.0), 4: (0.5, 1.5)},
    "router_log": {1: (0.10, 0.10), 2: (0.05, 0.08), 3: (0.40, 2.00), 4: (0.50, 1.50)},
}

# ---- FIXED VALUES: model catalogue (key, id, provider, api, max_tokens, images, thinking, context_window)
DEFAULT_MAX_TOKENS = 16384
MODEL_CATALOGUE = [
    ("glm-4.7", "glm-4.7", "zhipu", "openai-completions", 8192, False, True, None),
    ("glm-5", "glm-5", "zhipu", "openai-completions", 8192, False, True, None),
    ("claude-sonnet-4.5-copilot", "claude-sonnet-4.5", "github-copilot", "anthropic-copilot", 16384, True, True, None),
    ("claude-opus-4.5-copilot", "claude-opus-4.5", "github-copilot", "anthropic-copilot", 16384, True, True, None),
    ("claude-sonnet-4.6-copilot", "claude-sonnet-4.6", "github-copilot", "anthropic-copilot", 16384, True, True, None),
    ("claude-opus-4.6-copilot", "claude-opus-4.6", "github-copilot", "anthropic-copilot", 16384, True, True, None),
    ("gpt-5.3-codex-copilot", "gpt-5.3-codex", "github-copilot", "github-copilot-responses", 16384, True, True, None),
    ("gpt-5.3-codex", "gpt-5.3-codex", "openai-codex", "openai-codex-responses", 16384, True, True, None),
    ("ministral-3b-latest", "ministral-3b-latest", "model-router", "model-router", 8192, False, False, None),
]

# ---- FIXED VALUES: registered tools -------------------------------------
TOOLS = ["read", "edit", "write", "bash", "grep", "find"]

# ---- FIXED VALUES: stop-reason normalisation per provider layout --------
STOP_REASONS = [
    ("openai-completions", "stop", "stop"),
    ("openai-completions", "length", "length"),
    ("openai-completions", "tool_calls", "tool_use"),
    ("anthropic", "end_turn", "stop"),
    ("anthropic", "max_tokens", "length"),
    ("anthropic", "tool_use", "tool_use"),
]
DEFAULT_STOP_REASON = "stop"

# ---- FIXED VALUES: rubric (tier label, description) and query categories --
RUBRIC = [
    ("small", 1, "Simple, factual, or trivial queries that any small model can handle."),
    ("medium", 2, "Moderate complexity queries requiring some reasoning, synthesis, or structured output."),
    ("large", 3, "Complex queries requiring multi-step reasoning, analysis, or substantial coding."),
    ("xlarge", 4, "Expert-level queries requiring deep reasoning, novel problem-solving, or extensive generation."),
]
SEEDS_PER_TIER = 15
QUERY_CATEGORIES = [
    "mathematics",
    "coding_and_programming",
    "science_and_technology",
    "creative_writing",
    "business_and_finance",
    "education_and_learning",
    "health_and_medicine",
    "history_and_geography",
    "language_and_translation",
    "data_analysis",
    "system_design",
    "debugging",
    "general_knowledge",
    "philosophy_and_ethics",
    "legal_and_compliance",
]
# ---- end of fixed values -------------------------------------------------


def nano_per_token(usd_per_million: float) -> int:
    return int(round(usd_per_million * 1000))


# ---- FIXED VALUES: classifier system prompt used in training examples -----
SYSTEM_PROMPT = """You are a query complexity router for Mistral AI models. Given a user query, classify it into the appropriate model tier and provide a confidence score.

Output ONLY valid JSON in this exact format:
{"model_tier": <1|2|3|4>, "confidence": <0.0-1.0>}

Tier definitions:
- Tier 1 (small): Simple factual lookups, greetings, trivial math, yes/no questions
- Tier 2 (medium): Summarization, translation, moderate reasoning, simple coding
- Tier 3 (large): Complex analysis, multi-step reasoning, debugging, comparisons
- Tier 4 (xlarge): Expert-level research, novel problem-solving, proofs, system design"""
SFT_FEEDBACK_CONFIDENCE = 0.95
DPO_CHOSEN_CONFIDENCE = 1.0
DPO_REJECTED_DEFAULT_CONFIDENCE = 0.5
SPLIT_FRACTIONS = (0.8, 0.1)  # train, val; test takes the remainder
TIER_NUMBERS = [1, 2, 3, 4]
# ---- end of fixed values ---------------------------------------------------


# ---- FIXED VALUES: rubric criteria per tier and the generation prompt -----
RUBRIC_CRITERIA = {
    "small": [
        "Single-hop factual lookups (capitals, dates, definitions)",
        "Basic arithmetic (add, subtract, multiply, divide)",
        "Greetings and simple conversational turns",
        "Yes/No questions with obvious answers",
        "Simple format conversions (units, temperatures)",
        "Spelling or grammar of a single word",
    ],
    "medium": [
        "Summarize a short text or article",
        "Translate a paragraph between languages",
        "Explain a well-known concept in 2–3 sentences",
        "Simple coding tasks (write a function, fix a syntax error)",
        "List-based outputs (top 5, pros and cons)",
        "Basic data extraction or reformatting",
        "Multi-step arithmetic or word problems",
        "Simple creative writing (haiku, short poem)",
    ],
    "large": [
        "Debug a non-trivial code snippet with logical errors",
        "Compare and contrast two concepts with nuance",
        "Multi-paragraph explanations with examples",
        "Code that requires understanding of algorithms or data structures",
        "Analysis of trade-offs in technical decisions",
        "Chain-of-thought reasoning problems",
        "Writing with specific constraints (tone, audience, structure)",
        "Data analysis or interpretation questions",
    ],
    "xlarge": [
        "Mathematical proofs or formal logic",
        "System design for large-scale applications",
        "Research-level analysis or literature review",
        "Novel algorithm design or optimization",
        "Long-form content generation (essays, reports, documentation)",
        "Multi-domain synthesis (combining knowledge from different fields)",
        "Ambiguous or open-ended problems requiring creativity + expertise",
        "Security analysis, threat modeling, or architectural review",
    ],
}
GENERATION_PROMPT = """You are generating training data for a query router model. 
The router classifies user queries into complexity tiers.

{tier_description}

Category: {category}

Generate {count} diverse, realistic user queries that belong to Tier {tier_num} ({tier_label}).
The queries should:
- Be in the "{category}" category
- Match the complexity level described above
- Be diverse in phrasing and specific topics
- Be realistic queries a user might actually ask an AI assistant
- NOT include the tier label or any metadata — just the raw query text

Respond with a JSON array of strings, nothing else:
["query 1", "query 2", ...]"""
DATASET_SIZE = 5000
EXAMPLES_PER_TIER = DATASET_SIZE // 4
# ---- end of fixed values ---------------------------------------------------


def tier_description(label: str) -> str:
    tier = {lab: t for lab, t, _ in RUBRIC}[label]
    desc = {lab: d for lab, _, d in RUBRIC}[label]
    crit = "\n".join(f"  - {c}" for c in RUBRIC_CRITERIA[label])
    return f"Tier {tier} ({label}): {desc}\nCriteria:\n{crit}"
