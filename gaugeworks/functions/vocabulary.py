"""Words that route a question to a domain and to a named query."""

# Domain -> (term, weight), in declared order.
DOMAIN_TERMS = {
    "retail": [
        ("retail", 3), ("product", 3), ("products", 3), ("order", 2), ("orders", 2), ("sale", 2), ("sales", 2),
        ("inventory", 3), ("stock", 3), ("category", 2), ("store", 2), ("customer", 1), ("purchase", 2),
        ("sku", 3), ("best selling", 3),
    ],
    "finance": [
        ("finance", 3), ("financial", 3), ("revenue", 2), ("expense", 3), ("expenses", 3), ("profit", 3),
        ("margin", 3), ("budget", 3), ("cash", 2), ("burn", 3), ("income", 2), ("spend", 1), ("cost", 1),
        ("region", 1),
    ],
    "banking": [
        ("bank", 3), ("banking", 3), ("account", 3), ("accounts", 3), ("balance", 3), ("transfer", 3),
        ("transfers", 3), ("deposit", 3), ("loan", 3), ("loans", 3), ("kyc", 3), ("fraud", 3), ("flagged", 3),
        ("suspicious", 3), ("aml", 3), ("withdrawal", 2), ("transaction", 1),
    ],
    "healthcare": [
        ("health", 3), ("healthcare", 3), ("patient", 3), ("patients", 3), ("diagnosis", 3), ("hospital", 3),
        ("admission", 3), ("admitted", 3), ("department", 2), ("doctor", 3), ("medical", 3), ("clinical", 3),
        ("disease", 3), ("ward", 2), ("treatment", 2),
    ],
}

# Domain -> query -> keywords, in declared order.
INTENT_KEYWORDS = {
    "retail": {
        "top_products": ["top product", "best selling", "best-selling", "top selling", "bestseller"],
        "revenue_by_category": ["category", "categories"],
        "orders_by_status": ["status", "cancelled", "shipped", "pending", "delivered", "fulfil"],
        "low_stock": ["stock", "inventory", "restock", "low"],
        "top_customers": ["top customer", "best customer", "biggest customer", "spend"],
        "total_sales": ["total", "how much", "sales", "revenue"],
    },
    "finance": {
        "revenue_by_region": ["region", "geography", "geographic", "market"],
        "revenue_by_month": ["month", "monthly", "trend", "over time", "quarter"],
        "top_expenses": ["expense", "expenses", "cost", "spend", "spending"],
        "profit": ["profit", "margin", "net", "bottom line"],
        "total_revenue": ["revenue", "total", "income", "how much"],
    },
    "banking": {
        "flagged_transfers": ["flag", "flagged", "fraud", "suspicious", "aml", "laundering"],
        "high_value_transfers": ["high value", "largest transfer", "biggest transfer", "large transfer"],
        "loans_outstanding": ["loan", "loans", "outstanding", "principal", "delinquent"],
        "kyc_pending": ["kyc", "verification", "compliance", "onboarding"],
        "deposits_by_type": ["deposit", "balance", "account", "savings", "checking", "total"],
    },
    "healthcare": {
        "avg_cost": ["cost", "bill", "billing", "charge", "expense", "price"],
        "admissions": ["admit", "admission", "admitted", "inpatient"],
        "diagnosis_distribution": ["diagnosis", "condition", "disease", "illness"],
        "senior_patients": ["senior", "elderly", "old", "age", "geriatric"],
        "by_department": ["department", "ward", "unit", "how many", "count"],
    },
}

# The query run when no keyword of the domain occurs.
DEFAULT_INTENT = {
    "retail": "total_sales",
    "finance": "total_revenue",
    "banking": "deposits_by_type",
    "healthcare": "by_department",
}
