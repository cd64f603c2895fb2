"""DataFrame operators on images, faces, sidecar entries and embeddings."""
