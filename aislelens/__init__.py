"""aislelens: retail analytics on Spark DataFrames.

Raw customer, order, inventory, CRM and staffing tables become cleaned
silver tables, gold profiles, inventory health, staffing gaps, a demand
forecast, churn labels/scores and the KPI, text and assistant queries that
read them.
"""

__version__ = "0.1.0"
