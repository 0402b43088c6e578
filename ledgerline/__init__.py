"""Report-shaped analytics as DataFrame and Column operations."""
