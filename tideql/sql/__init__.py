"""The SQL dialect: text to syntax trees."""
