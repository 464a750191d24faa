"""DataFrame operators over decks, sections, slides, blocks, assets, anchors and edits."""
