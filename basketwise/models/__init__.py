"""Tree-ensemble models for churn, customer value and pair strength."""
