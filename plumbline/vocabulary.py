"""Closed vocabularies.

Fixed values that results depend on: families of categories, categories of
headlines and their terms, sentiment words, metric aliases and ratios.
"""

from __future__ import annotations

CATEGORY_FAMILY = {
    "macro_rates": "macro_environment",
    "regulation_legal": "policy_decision",
    "etf_institutional": "money_movement",
    "security_incident": "security_incident",
    "exchange_incident": "security_incident",
    "whale_onchain": "money_movement",
    "listing_trading": "market_structure",
    "mining_energy": "macro_environment",
    "corporate_earnings": "corporate_fundamental",
    "geopolitics": "macro_environment",
    "market_sentiment": "sentiment_emotion",
}
RATIOS = (
    ("liabilities_to_assets", "total_liabilities", "total_assets"),
    ("equity_to_assets", "total_equity", "total_assets"),
    ("debt_to_assets", "total_debt", "total_assets"),
    ("debt_to_equity", "total_debt", "total_equity"),
    ("net_margin", "net_income", "revenue"),
    ("return_on_assets", "net_income", "total_assets"),
    ("return_on_equity", "net_income", "total_equity"),
    ("cash_to_assets", "cash_and_equivalents", "total_assets"),
)
#: Words of the lexical sentiment and of its language screen.
NEGATORS = [
    "not", "no", "never", "neither", "nor", "without", "cannot", "can't", "won't", "don't", "doesn't", "didn't",
    "isn't", "aren't", "wasn't", "weren't", "hardly", "barely", "lack", "lacks", "lacking",
]
POSITIVE_WORDS = [
    "profit", "profits", "profitable", "gain", "gains", "growth", "growing", "strong", "stronger", "resilient",
    "stable", "improve", "improved", "improvement", "success", "successful", "robust", "efficient", "expansion",
    "exceeded", "outperform", "outperformed", "upgrade", "upgraded", "benefit", "benefits", "surplus", "recovery",
    "good",
]
NEGATIVE_WORDS = [
    "loss", "losses", "decline", "declined", "declining", "weak", "weaker", "bad", "worse", "poor", "failed",
    "failure", "default", "defaulted", "fraud", "fraudulent", "lawsuit", "litigation", "penalty", "penalties",
    "fined", "sanctions", "investigation", "breach", "violation", "warning", "downgrade", "downgraded", "bankruptcy",
    "insolvency", "crisis", "risk", "risks", "risky", "layoffs", "impairment", "scandal", "misconduct", "shortfall",
    "deficit", "plunge", "slump", "concern", "concerns",
]
ENGLISH_WORDS = [
    "the", "a", "an", "this", "that", "these", "those", "is", "are", "was", "were", "be", "been", "has", "have",
    "had", "and", "or", "but", "with", "of", "for", "in", "on", "to", "from", "by", "it", "its", "we", "they", "our",
    "their", "very", "reported", "reports", "report", "bank", "banks", "company", "earnings", "revenue", "assets",
    "liabilities", "equity", "cash", "debt", "quarter", "year", "financial", "results", "outlook", "regulator",
    "regulators", "shareholder", "shareholders", "ownership", "criticism", "supervision", "meeting", "today",
    "announced", "despite", "however", "yet", "only", "all", "more", "than", "as", "at",
]
FOREIGN_MARKERS = [
    "le", "la", "les", "des", "une", "est", "avec", "mais", "pas", "und", "der", "die", "das", "ist", "nicht", "el",
    "los", "las", "una", "es", "con", "pero", "sin", "del", "un", "il", "della", "che", "non", "uma", "nao", "com",
    "het", "een", "van", "niet",
]
#: Words of the headline lexicon.
POSITIVE_HEADLINE = [
    "surge", "surges", "surged", "soar", "soars", "soared", "rally", "rallies", "rallied", "jump", "jumps", "jumped",
    "gain", "gains", "gained", "rise", "rises", "rose", "climb", "climbs", "climbed", "record high", "all-time high",
    "bullish", "optimism", "optimistic", "breakout", "momentum", "accumulation", "inflows", "buying", "demand",
    "approval", "approved", "adopts", "eases", "eased", "boost", "boosts", "boosted", "recovery", "rebound",
    "rebounds", "rebounding", "profit", "profits", "beat", "beats",
]
NEGATIVE_HEADLINE = [
    "plunge", "plunges", "plunged", "crash", "crashes", "crashed", "slump", "slumps", "slumped", "tumble", "tumbles",
    "tumbled", "fall", "falls", "fell", "drop", "drops", "dropped", "sink", "sinks", "sank", "slide", "slides",
    "slid", "collapse", "collapses", "collapsed", "bearish", "fear", "fears", "panic", "sell-off", "selloff", "dump",
    "dumps", "dumped", "liquidations", "liquidation", "hack", "hacked", "exploit", "stolen", "theft", "scam",
    "fraud", "ban", "banned", "crackdown", "lawsuit", "sues", "sued", "probe", "investigation", "fined", "penalty",
    "outage", "bankruptcy", "delisting", "delisted", "depeg", "capitulation", "correction", "warning", "warns",
    "loss", "losses", "halted", "suspended", "freeze", "frozen", "seized",
]
NEGATORS_HEADLINE = ["not", "no", "never", "without", "denies", "denied", "fails", "failed"]
