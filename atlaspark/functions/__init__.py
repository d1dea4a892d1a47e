"""Part of the atlaspark engine; see the README for the layout."""
