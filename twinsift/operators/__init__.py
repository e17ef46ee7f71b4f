"""DataFrame-to-DataFrame operators over file relations."""
