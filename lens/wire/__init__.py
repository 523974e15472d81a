"""The front door for PostgreSQL clients, and the page that shows what they ask."""
