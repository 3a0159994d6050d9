"""Built-in rule catalog (E16): 40 finance, health and enterprise rules.

Fixed values: names, rule texts, severities, enforcement levels and
frameworks as published by the reference catalog, in its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values (domain, name, rule, severity, enforcement level, frameworks).
CATALOG = [
    ("financial", "customer_age", "age >= 18 AND age <= 120", "CRITICAL", "HARD", ["KYC", "BSA"]),
    ("financial", "customer_residency",
     "residence_country IN ('US', 'UK', 'CA', 'AU', 'DE', 'FR') OR tax_residency IS NOT NULL", "HIGH", "SOFT", []),
    ("financial", "account_balance", "balance >= 0", "CRITICAL", "HARD", ["GAAP", "IFRS"]),
    ("financial", "minimum_balance_savings", "IF account_type == 'savings' THEN balance >= 100", "HIGH", "HARD",
     ["Regulation D", "Basel III"]),
    ("financial", "minimum_balance_checking",
     "IF account_type == 'checking' AND account_tier == 'premium' THEN balance >= 1500", "MEDIUM", "SOFT", []),
    ("financial", "account_type_classification",
     "account_type IN ('savings', 'checking', 'money_market', 'cd', 'ira', 'brokerage', 'business_checking')",
     "HIGH", "HARD", []),
    ("financial", "credit_score_range", "credit_score >= 300 AND credit_score <= 850", "CRITICAL", "HARD",
     ["FCRA", "ECOA"]),
    ("financial", "credit_score_by_age", "IF age < 21 THEN credit_score <= 750 OR credit_score IS NULL", "MEDIUM",
     "SOFT", []),
    ("financial", "debt_to_income_ratio", "IF annual_income > 0 THEN (total_monthly_debt * 12) / annual_income <= 0.43",
     "HIGH", "HARD", ["QM Rule", "Dodd-Frank"]),
    ("financial", "credit_utilization", "IF credit_limit > 0 THEN credit_balance / credit_limit <= 0.30", "MEDIUM",
     "SOFT", []),
    ("financial", "employment_status",
     "employment_status IN ('employed_full_time', 'employed_part_time', 'self_employed', 'unemployed', 'retired', 'student')",
     "HIGH", "HARD", []),
    ("financial", "income_by_employment",
     "IF employment_status == 'unemployed' THEN annual_income <= 20000 OR income_source IN ('investment', 'pension', 'alimony')",
     "MEDIUM", "SOFT", []),
    ("financial", "business_account_age", "IF account_type == 'business' THEN age >= 18", "CRITICAL", "HARD", []),
    ("financial", "daily_transaction_limit", "daily_transaction_amount <= 10000", "HIGH", "HARD", ["Regulation E"]),
    ("financial", "monthly_transaction_volume", "monthly_transaction_count <= 1000", "HIGH", "SOFT", ["AML", "BSA"]),
    ("financial", "large_transaction_escalation", "IF transaction_amount > 10000 THEN transaction_reporting_flag = True",
     "CRITICAL", "HARD", ["BSA", "FinCEN"]),
    ("financial", "account_creation_temporal", "account_creation_date <= current_date", "CRITICAL", "HARD", []),
    ("financial", "transaction_chronology", "last_transaction_date >= account_creation_date", "CRITICAL", "HARD", []),
    ("financial", "account_age_consistency",
     "IF account_creation_date IS NOT NULL AND current_date IS NOT NULL THEN (current_date - account_creation_date).days >= 0",
     "CRITICAL", "HARD", []),
    ("healthcare", "patient_age", "age >= 0 AND age <= 120", "CRITICAL", "HARD", ["HIPAA"]),
    ("healthcare", "age_gender_consistency",
     "IF gender == 'female' AND age > 120 THEN gender_verification_required = True", "MEDIUM", "SOFT", []),
    ("healthcare", "body_temperature", "temperature_celsius BETWEEN 32.0 AND 42.0", "CRITICAL", "HARD", []),
    ("healthcare", "heart_rate", "heart_rate_bpm BETWEEN 30 AND 220", "HIGH", "HARD", []),
    ("healthcare", "blood_pressure_systolic", "bp_systolic BETWEEN 70 AND 250", "HIGH", "HARD", []),
    ("healthcare", "blood_pressure_diastolic", "bp_diastolic BETWEEN 40 AND 150", "HIGH", "HARD", []),
    ("healthcare", "bp_gradient", "bp_systolic > bp_diastolic", "CRITICAL", "HARD", []),
    ("healthcare", "body_mass_index", "bmi BETWEEN 12 AND 60", "MEDIUM", "SOFT", []),
    ("healthcare", "glucose_levels", "blood_glucose_mgdl BETWEEN 20 AND 600", "HIGH", "HARD", []),
    ("healthcare", "hemoglobin_a1c", "hba1c_percent BETWEEN 4.0 AND 15.0", "HIGH", "HARD", []),
    ("healthcare", "cholesterol_total", "total_cholesterol_mgdl BETWEEN 50 AND 500", "MEDIUM", "SOFT", []),
    ("healthcare", "medication_dosage", "IF medication_class == 'opioid' THEN daily_dosage_mme <= 90", "CRITICAL",
     "HARD", ["CDC Guideline", "DEA"]),
    ("healthcare", "medication_age_restriction",
     "IF medication_category IN ('antibiotic', 'antiviral') AND age < 18 THEN pediatric_dosing_flag = True",
     "HIGH", "SOFT", []),
    ("healthcare", "visit_chronology", "admission_date <= discharge_date", "CRITICAL", "HARD", []),
    ("healthcare", "followup_interval",
     "IF procedure_type == 'surgery' THEN followup_date BETWEEN surgery_date AND surgery_date + 90", "MEDIUM",
     "SOFT", []),
    ("healthcare", "diagnosis_age_appropriate",
     "IF diagnosis_code LIKE 'P%' AND age > 1 THEN diagnosis_verification_required = True", "HIGH", "HARD",
     ["ICD-10"]),
    ("healthcare", "gender_specific_diagnosis",
     "IF diagnosis_code IN ('N97', 'O00-O9A') AND gender != 'female' THEN diagnosis_flag_inconsistent = True",
     "CRITICAL", "HARD", []),
    ("enterprise", "data_completeness", "required_fields NOT NULL FOR customer_id, account_id, transaction_id",
     "CRITICAL", "HARD", []),
    ("enterprise", "referential_integrity", "FOR customer_id IN transactions EXISTS customer_id IN customers",
     "CRITICAL", "HARD", []),
    ("enterprise", "historical_consistency", "effective_date <= termination_date OR termination_date IS NULL",
     "HIGH", "HARD", []),
    ("enterprise", "version_control", "record_version >= previous_record_version", "MEDIUM", "SOFT", []),
]


def catalog_table(spark: SparkSession) -> DataFrame:
    """The catalog as a table (domain, name, rule, severity, level,
    frameworks)."""
    return spark.createDataFrame(
        CATALOG, "domain string, name string, rule string, severity string, level string, frameworks array<string>")
