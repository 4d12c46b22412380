"""See the README for what each package holds."""
