"""Part of krylark."""
