"""Intents, categories, flag letters, slot names. They define the results and never vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Intents that need a human.
ESCALATION_INTENTS = (
    "complaint",
    "contact_human_agent",
    "contact_customer_service",
    "payment_issue",
    "get_refund",
    "check_cancellation_fee",
    "registration_problems",
)

SELF_SERVICE = "self_service"

# Why an escalation intent needs a human.
RATIONALE = {
    "contact_human_agent": "human_request",
    "contact_customer_service": "human_request",
    "complaint": "negative_sentiment",
    "payment_issue": "financial_liability",
    "get_refund": "financial_liability",
    "check_cancellation_fee": "financial_liability",
    "registration_problems": "account_access",
}

# The intents of each request category.
CATEGORY_INTENTS = {
    "ACCOUNT": ("create_account", "delete_account", "edit_account", "recover_password", "registration_problems", "switch_account"),
    "CANCELLATION_FEE": ("check_cancellation_fee",),
    "CONTACT": ("contact_customer_service", "contact_human_agent"),
    "DELIVERY": ("delivery_options", "delivery_period"),
    "FEEDBACK": ("complaint", "review"),
    "INVOICE": ("check_invoice", "get_invoice"),
    "ORDER": ("cancel_order", "change_order", "place_order", "track_order"),
    "PAYMENT": ("check_payment_methods", "payment_issue"),
    "REFUND": ("check_refund_policy", "get_refund", "track_refund"),
    "SHIPPING_ADDRESS": ("change_shipping_address", "set_up_shipping_address"),
    "SUBSCRIPTION": ("newsletter_subscription",),
}

# Letters of the language tags carried by each request.
FLAG_NAMES = {
    "B": "basic_syntax",
    "I": "interrogative",
    "C": "coordinated_syntax",
    "N": "negation",
    "M": "morphological_var",
    "L": "semantic_var",
    "P": "polite",
    "Q": "colloquial",
    "W": "offensive",
    "K": "keyword_mode",
    "E": "abbreviations",
    "Z": "typos_errors",
}

# Letters that are described but never used.
RESERVED_FLAGS = {"D": "indirect_speech", "G": "regional", "R": "respect", "Y": "code_switching"}

# Grids of cut-offs, in the order they are tried.
COARSE_GRID = tuple(k / 100 for k in range(20, 81, 5))
FINE_GRID = tuple(k / 1000 for k in range(10, 991, 5))


def intent_dimension(spark: SparkSession) -> DataFrame:
    """One row per known intent: category, target and the reason for escalation (27 rows, fixed)."""
    rows = [
        (intent, category, int(intent in ESCALATION_INTENTS), RATIONALE.get(intent, SELF_SERVICE))
        for category, intents in CATEGORY_INTENTS.items()
        for intent in intents
    ]
    return spark.createDataFrame(rows, "intent string, category string, escalated int, rationale string")
