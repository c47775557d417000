"""Composite jobs: extraction, validation, integration, registration, views and output cells."""
