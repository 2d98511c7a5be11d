"""DataFrame operators: silver, gold, forecast, churn, KPIs, text, assistant."""
