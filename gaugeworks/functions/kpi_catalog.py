"""The KPI catalog and the audiences that read it."""

from __future__ import annotations

from typing import NamedTuple


class Kpi(NamedTuple):
    id: str
    name: str
    formula: str
    unit: str
    higher_is_better: bool
    target: float | None = None
    alert_pct: float | None = None


# The catalog in its declared order.
CATALOG = [
    Kpi("fin_revenue_total", "Total Revenue", "SUM(revenue.amount)", "currency", True),
    Kpi("fin_revenue_growth_yoy", "Revenue Growth YoY", "(SUM(revenue.amount this_year) - SUM(revenue.amount last_year)) / SUM(revenue.amount last_year)", "percent", True, alert_pct=10.0),
    Kpi("fin_gross_margin", "Gross Margin", "(SUM(revenue) - SUM(cogs)) / SUM(revenue)", "percent", True),
    Kpi("fin_operating_margin", "Operating Margin", "SUM(operating_income) / SUM(revenue)", "percent", True),
    Kpi("fin_ebitda", "EBITDA", "SUM(operating_income) + SUM(depreciation) + SUM(amortization)", "currency", True),
    Kpi("fin_burn_rate", "Monthly Burn Rate", "AVG(cash_outflow per month)", "currency", False),
    Kpi("fin_runway_months", "Runway (Months)", "cash_balance / monthly_burn", "number", True),
    Kpi("fin_cac", "Customer Acquisition Cost", "SUM(sales_marketing_spend) / COUNT(new_customers)", "currency", False),
    Kpi("fin_ltv", "Customer Lifetime Value", "AVG(customer_revenue * customer_lifespan_months)", "currency", True),
    Kpi("fin_ltv_cac", "LTV / CAC Ratio", "ltv / cac", "ratio", True, target=3.0),
    Kpi("fin_dso", "Days Sales Outstanding", "AVG(receivables_days)", "days", False),
    Kpi("fin_budget_variance", "Budget Variance", "(SUM(actual) - SUM(plan)) / SUM(plan)", "percent", False, alert_pct=10.0),
    Kpi("sls_pipeline_value", "Pipeline Value", "SUM(opportunity.amount WHERE stage NOT IN closed)", "currency", True),
    Kpi("sls_win_rate", "Win Rate", "COUNT(won) / COUNT(closed)", "percent", True),
    Kpi("sls_avg_deal_size", "Average Deal Size", "AVG(opportunity.amount WHERE won)", "currency", True),
    Kpi("sls_sales_cycle_days", "Sales Cycle Length", "AVG(close_date - created_date)", "days", False),
    Kpi("sls_quota_attainment", "Quota Attainment", "SUM(actual_revenue) / SUM(quota)", "percent", True, target=1.0),
    Kpi("sls_funnel_conversion", "Funnel Conversion Rate", "COUNT(stage_n) / COUNT(stage_n_minus_1)", "percent", True),
    Kpi("sls_lead_response_time", "Lead Response Time", "AVG(first_contact - created)", "days", False),
    Kpi("sls_arr", "Annual Recurring Revenue", "SUM(active_subscription.annual_value)", "currency", True),
    Kpi("sls_arr_growth", "ARR Growth Rate", "(arr_current - arr_prior) / arr_prior", "percent", True, alert_pct=5.0),
    Kpi("sls_net_revenue_retention", "Net Revenue Retention", "(starting_arr + expansion - churn - contraction) / starting_arr", "percent", True, target=1.1),
    Kpi("ops_uptime", "Service Uptime", "1 - (downtime_seconds / total_seconds)", "percent", True, target=0.999),
    Kpi("ops_mttr", "Mean Time To Recovery", "AVG(resolved_at - incident_started)", "minutes", False),
    Kpi("ops_mtbf", "Mean Time Between Failures", "AVG(time_between_incidents)", "days", True),
    Kpi("ops_throughput", "Throughput (per hour)", "COUNT(transactions) / hours", "number", True),
    Kpi("ops_error_rate", "Error Rate", "COUNT(errors) / COUNT(requests)", "percent", False, alert_pct=1.0),
    Kpi("ops_p95_latency", "P95 Latency", "PERCENTILE(latency_ms, 0.95)", "ms", False),
    Kpi("ops_inventory_turnover", "Inventory Turnover", "SUM(cogs) / AVG(inventory_value)", "ratio", True),
    Kpi("ops_capacity_utilization", "Capacity Utilization", "actual_output / max_capacity", "percent", True),
    Kpi("hr_headcount", "Total Headcount", "COUNT(active_employees)", "number", True),
    Kpi("hr_attrition_rate", "Attrition Rate (Annualized)", "12 * COUNT(departures last_month) / AVG(headcount last_month)", "percent", False, alert_pct=2.0),
    Kpi("hr_voluntary_attrition", "Voluntary Attrition", "COUNT(voluntary_departures) / AVG(headcount)", "percent", False),
    Kpi("hr_time_to_hire", "Time to Hire (Days)", "AVG(start_date - requisition_open_date)", "days", False),
    Kpi("hr_offer_acceptance", "Offer Acceptance Rate", "COUNT(accepted_offers) / COUNT(extended_offers)", "percent", True),
    Kpi("hr_engagement_score", "Employee Engagement Score", "AVG(survey.engagement)", "number", True, target=4.0),
    Kpi("hr_training_hours", "Training Hours per Employee", "SUM(training_hours) / COUNT(employees)", "number", True),
    Kpi("hr_diversity_pct", "Diversity %", "COUNT(underrepresented) / COUNT(total)", "percent", True),
    Kpi("hr_contractor_ratio", "Contractor Ratio", "COUNT(contractors) / COUNT(total_workforce)", "percent", False),
    Kpi("hr_cost_per_hire", "Cost per Hire", "SUM(recruiting_spend) / COUNT(hires)", "currency", False),
    Kpi("cust_nps", "Net Promoter Score", "% promoters - % detractors", "number", True, target=50.0),
    Kpi("cust_csat", "CSAT Score", "AVG(satisfaction_score)", "number", True),
    Kpi("cust_churn_rate", "Customer Churn Rate", "COUNT(churned) / COUNT(start_period)", "percent", False, alert_pct=1.0),
    Kpi("cust_revenue_churn", "Revenue Churn", "SUM(churned_arr) / SUM(starting_arr)", "percent", False),
    Kpi("cust_first_response_time", "First Response Time", "AVG(first_response - ticket_created)", "minutes", False),
    Kpi("cust_resolution_time", "Resolution Time", "AVG(resolved_at - ticket_created)", "hours", False),
    Kpi("cust_active_users", "Monthly Active Users", "COUNT(DISTINCT user_id WHERE event in last_30d)", "number", True),
    Kpi("cust_dau_mau", "DAU/MAU Ratio", "DAU / MAU", "ratio", True),
    Kpi("risk_fraud_rate", "Fraud Rate", "SUM(fraud_amount) / SUM(transaction_amount)", "percent", False, alert_pct=0.5),
    Kpi("risk_false_positive_rate", "False Positive Rate (Fraud)", "COUNT(fp_alerts) / COUNT(alerts)", "percent", False),
    Kpi("risk_aml_alerts", "AML Alerts (open)", "COUNT(open_aml_alerts)", "number", False),
    Kpi("risk_audit_findings", "Open Audit Findings", "COUNT(audit_findings WHERE status='open')", "number", False),
    Kpi("risk_security_incidents", "Security Incidents", "COUNT(incidents WHERE severity>=high)", "number", False),
    Kpi("prod_feature_adoption", "Feature Adoption Rate", "COUNT(users using feature) / COUNT(eligible users)", "percent", True),
    Kpi("prod_release_frequency", "Release Frequency", "COUNT(releases per month)", "number", True),
    Kpi("prod_lead_time_changes", "Lead Time for Changes", "AVG(deploy_time - commit_time)", "hours", False),
    Kpi("prod_change_failure_rate", "Change Failure Rate", "COUNT(failed_deploys) / COUNT(deploys)", "percent", False),
    Kpi("prod_bug_count", "Open Bugs (P0+P1)", "COUNT(bugs WHERE priority IN (P0,P1) AND status='open')", "number", False),
]

# Audience id -> name and default KPIs.
AUDIENCES = {
    "aud_cfo": ("CFO / Finance Leader", ["fin_revenue_total", "fin_revenue_growth_yoy", "fin_gross_margin", "fin_burn_rate", "fin_runway_months", "fin_budget_variance"]),
    "aud_ceo": ("CEO / Founder", ["fin_revenue_total", "sls_arr", "sls_arr_growth", "cust_churn_rate", "cust_nps", "hr_attrition_rate"]),
    "aud_revops": ("RevOps Lead", ["sls_pipeline_value", "sls_win_rate", "sls_sales_cycle_days", "sls_quota_attainment", "sls_funnel_conversion"]),
    "aud_hr": ("Head of People", ["hr_headcount", "hr_attrition_rate", "hr_voluntary_attrition", "hr_time_to_hire", "hr_engagement_score"]),
    "aud_cs": ("Customer Success Leader", ["cust_churn_rate", "cust_nps", "cust_active_users", "cust_first_response_time", "sls_net_revenue_retention"]),
    "aud_eng": ("Engineering Leader", ["prod_release_frequency", "prod_lead_time_changes", "prod_change_failure_rate", "ops_uptime", "ops_mttr", "prod_bug_count"]),
    "aud_risk": ("Risk / Compliance Officer", ["risk_fraud_rate", "risk_false_positive_rate", "risk_aml_alerts", "risk_audit_findings", "risk_security_incidents"]),
}
