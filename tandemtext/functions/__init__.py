"""See the README for what each module here holds."""
