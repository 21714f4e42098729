"""Part of the corpuscle engine; see the README for the layout."""
